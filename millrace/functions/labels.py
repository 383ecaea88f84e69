"""Label taxonomy: ordered pattern rules as one CASE expression, ids and multi-hot vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The taxonomy's labels and its ordered patterns.
MAJORS = ("benign", "dos_ddos", "bruteforce", "web_attack", "botnet_malware", "scan", "infiltration", "heartbleed", "other_attack")
MINORS = {
    "benign": (),
    "dos_ddos": ("dos", "ddos", "dos_hulk", "dos_goldeneye", "dos_slowloris", "dos_slowhttptest"),
    "bruteforce": ("ftp_patator", "ssh_patator", "brute_force"),
    "web_attack": ("sql_injection", "xss", "web_bruteforce"),
    "botnet_malware": ("botnet", "malware", "backdoor", "cridex", "geodo", "htbot", "miuref", "neris", "nsis", "shifu", "shellcode", "tinba", "virut", "worms", "zeus"),
    "scan": ("portscan", "reconnaissance", "scan"),
    "infiltration": ("infiltration",),
    "heartbleed": ("heartbleed",),
    "other_attack": ("analysis_attack", "exploit", "fuzzing", "generic_attack", "other_attack"),
}
RULES = (
    ("^BENIGN$|^Normal$|^Background$", "benign", ""),
    ("^DDoS$|DDoS", "dos_ddos", "ddos"),
    ("DoS Hulk", "dos_ddos", "dos_hulk"),
    ("DoS GoldenEye", "dos_ddos", "dos_goldeneye"),
    ("DoS slowloris", "dos_ddos", "dos_slowloris"),
    ("DoS Slowhttptest|DoS slowhttptest", "dos_ddos", "dos_slowhttptest"),
    ("^DoS$", "dos_ddos", "dos"),
    ("FTP-Patator", "bruteforce", "ftp_patator"),
    ("SSH-Patator", "bruteforce", "ssh_patator"),
    ("Web Attack.*Brute Force", "web_attack", "web_bruteforce"),
    ("^Brute Force$|Bruteforce", "bruteforce", "brute_force"),
    ("Web Attack - Sql Injection|SQL Injection", "web_attack", "sql_injection"),
    ("Web Attack - XSS|XSS", "web_attack", "xss"),
    (r"\bBot(?:net)?\b", "botnet_malware", "botnet"),
    ("PortScan|Port Scan", "scan", "portscan"),
    ("^Reconnaissance$", "scan", "reconnaissance"),
    ("Infiltration", "infiltration", "infiltration"),
    ("Heartbleed", "heartbleed", "heartbleed"),
    ("Cridex", "botnet_malware", "cridex"),
    ("^Backdoor$", "botnet_malware", "backdoor"),
    ("Geodo", "botnet_malware", "geodo"),
    ("Htbot", "botnet_malware", "htbot"),
    ("Miuref", "botnet_malware", "miuref"),
    ("Neris", "botnet_malware", "neris"),
    ("Nsis", "botnet_malware", "nsis"),
    ("Shifu", "botnet_malware", "shifu"),
    ("^Shellcode$", "botnet_malware", "shellcode"),
    ("Tinba", "botnet_malware", "tinba"),
    ("Virut", "botnet_malware", "virut"),
    ("^Worms$", "botnet_malware", "worms"),
    ("Zeus", "botnet_malware", "zeus"),
    ("^Analysis$", "other_attack", "analysis_attack"),
    ("^Exploits$", "other_attack", "exploit"),
    ("^Fuzzers$", "other_attack", "fuzzing"),
    ("^Generic$", "other_attack", "generic_attack"),
)
FALLBACK = ("other_attack", "other_attack")
# End of the fixed values.

ALL_MINORS = tuple(m for major in MAJORS for m in MINORS[major])


def mapped(source: Column, rules=RULES, fallback=FALLBACK) -> Column:
    """Struct major_label, minor_labels: those of the first rule whose pattern is found in the label, whatever its case."""
    text = F.trim(F.coalesce(source, F.lit("")))
    target = lambda major, minor: F.struct(F.lit(major).alias("major_label"), (F.array(F.lit(minor)) if minor else F.array().cast("array<string>")).alias("minor_labels"))
    out = F.when(text == "", target(*fallback))
    for pattern, major, minor in rules:
        out = out.when(text.rlike(f"(?i){pattern}"), target(major, minor))
    return out.otherwise(target(*fallback))


def map_labels(df: DataFrame, source: str) -> DataFrame:
    """df with major_label and minor_labels. Rules run once for each label that occurs; there are few of those, so they are broadcast by size."""
    known = df.select(F.col(source)).distinct().withColumn("m", mapped(F.col(source)))
    named = known.select(F.col(source).alias("_source"), "m.major_label", "m.minor_labels")
    return df.join(named, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


def major_id(major: Column, majors=MAJORS) -> Column:
    """Place of a label in the list, null if it is not there."""
    at = F.array_position(F.array(*map(F.lit, majors)), major)
    return F.when(at > 0, (at - 1).cast("int"))


def minor_multi_hot(minors: Column, names=ALL_MINORS) -> Column:
    return F.transform(F.array(*map(F.lit, names)), lambda n: F.array_contains(minors, n).cast("double"))


def minor_major_ids() -> list[int]:
    return [k for k, major in enumerate(MAJORS) for _ in MINORS[major]]
