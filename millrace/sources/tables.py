"""Other inputs: zipped CSV, payload CSV, JSON lines, configurations."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import normalized_name, protocol_name, trimmed_payload_length


def zipped_csv_name(names: list[str], parts: tuple[str, ...]) -> str:
    """The one CSV whose name holds all parts, whatever their case; an error if there is none or more."""
    found = [n for n in names if n.lower().endswith(".csv") and all(p.lower() in n.lower() for p in parts)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} CSV files with {parts}")
    return found[0]


def read_zipped_csv(spark: SparkSession, archive: str, parts: tuple[str, ...], target: str) -> DataFrame:
    """The CSV is unpacked, in blocks, to target, a folder that executors can read; all columns are text."""
    with zipfile.ZipFile(archive) as z:
        name = zipped_csv_name(z.namelist(), parts)
        out = Path(target) / Path(name).name
        out.parent.mkdir(parents=True, exist_ok=True)
        with z.open(name) as source, out.open("wb") as sink:
            while block := source.read(1 << 20):
                sink.write(block)
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(str(out))


def payload_columns(columns: list[str], prefix: str = "payload_byte_") -> list[str]:
    """Byte columns in the order of their numbers."""
    return sorted((c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))


def payload_flows(df: DataFrame, dataset: str, order: str, drop_empty: bool = True) -> DataFrame:
    """A wide table of byte values as one flow of one packet for each row: trailing zeros go, those inside stay.

    order: a column with the row's number in its source. Missing ttl, total_len and t_delta are 0.
    """
    names = payload_columns(df.columns)
    values = F.array(*[F.coalesce(F.col(n).try_cast("int"), F.lit(0)) for n in names])
    optional = lambda n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    rows = df.withColumn("_v", values).withColumn("payload_byte_length", trimmed_payload_length(F.col("_v")))
    hexed = F.array_join(F.transform(F.slice("_v", 1, F.col("payload_byte_length")), lambda v: F.lpad(F.hex(v), 2, "0")), "")
    out = rows.select(
        F.concat_ws(":", F.lit(dataset), F.lit("packet"), F.col(order).cast("string")).alias("flow_id"), F.trim("label").alias("source_label"),
        protocol_name(F.col("protocol") if "protocol" in df.columns else F.lit(None)).alias("protocol"), optional("ttl").alias("ttl"), optional("total_len").alias("total_len"), optional("t_delta").alias("t_delta"),
        "payload_byte_length", F.unhex(hexed).alias("bytes"),
    )
    return out.where("payload_byte_length > 0") if drop_empty else out


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df if limit is None else df.limit(limit)


def load_config(path: str) -> dict:
    """A YAML mapping; anything else is an error."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return found


def nested(config: dict, path: str, default=None):
    """The value at a dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def build_configs(config: dict) -> list[dict]:
    """One mapping for each dataset, the shared `build` block under its own values; a mapping without datasets is one itself."""
    shared = config.get("build", {})
    sets = config.get("datasets")
    return [{**shared, **d} for d in sets] if sets else [{**shared, **{k: v for k, v in config.items() if k != "build"}}]


def with_normalized_names(df: DataFrame) -> DataFrame:
    return df.toDF(*map(normalized_name, df.columns))


def source_label(mode: str, file: str = "source_file", static: str | None = None):
    """Label of a flow from its file: static, parent, filename or parent_filename."""
    path = F.col(file)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    parent = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    if mode == "static" and static:
        return F.lit(static)
    if mode in ("parent", "filename", "parent_filename"):
        return {"parent": parent, "filename": stem, "parent_filename": F.concat_ws("_", parent, stem)}[mode]
    raise ValueError(f"no source label from {mode}")


def is_fresh(manifest: str, parameters: dict) -> bool:
    """Whether a shard's manifest names just these parameters, every one of them."""
    p = Path(manifest)
    return p.is_file() and json.loads(p.read_text()) == json.loads(json.dumps(parameters))
