"""Commands: python -m millrace.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def build(a: argparse.Namespace) -> None:
    from millrace.plans import build as b
    from millrace.sources import pcap

    b.extract(pcap.read_packets(session(), a.input), a.idle, a.cap, a.closing).write.mode("overwrite").option("compression", "zstd").parquet(a.output)


def split(a: argparse.Namespace) -> None:
    from millrace.plans import build as b
    from millrace.sources import sinks

    rows, report = b.split_and_audit(session().read.parquet(a.input), a.group, a.stratum, a.method)
    sinks.write_splits(rows, a.output)
    print(json.dumps([r.asDict() for r in report.collect()]))


def merge(a: argparse.Namespace) -> None:
    from millrace.operators.summary import merged_shards

    s = session()
    merged_shards([s.read.parquet(p) for p in a.input], ["flow_id", "source_label", "major_label"], ["start_time"]).write.mode("overwrite").option("compression", "zstd").parquet(a.output)


def stats(a: argparse.Namespace) -> None:
    from millrace.operators.audit import dataset_stats

    print(json.dumps(dataset_stats(session().read.parquet(a.input), "flow_id", "payload_byte_length", "was_packet_truncated").first().asDict()))


def validate(a: argparse.Namespace) -> None:
    from millrace.operators.audit import validation

    df = session().read.parquet(a.input)
    df = df if "view" in df.columns else df.withColumn("view", F.lit("payload_only"))
    found = validation(df, ["flow_id", "major_label", "packet_count", "payload_byte_length"], "major_label", "packet_count", "payload_byte_length", "flow_id", "view", "packet_directions", "packet_lengths").collect()
    print(json.dumps([r.asDict() for r in found]))


def vocab(a: argparse.Namespace) -> None:
    from millrace.functions.tokens import vocabulary
    from millrace.sources.sinks import write_vocabulary

    write_vocabulary(session(), vocabulary(), a.output)


def codebook(a: argparse.Namespace) -> None:
    from millrace.operators import codebook as c
    from millrace.sources.sinks import put_text

    df = session().read.parquet(a.input)
    book = c.lifted(df, "bytes", a.label, a.size, a.entries, a.least, a.target) if a.label else c.frequent(df, "bytes", a.size, a.entries, a.least)
    put_text(df.sparkSession, a.output, c.to_json(book, "label_lift_byte_chunk" if a.label else "frequency_byte_chunk", a.size))


def baseline(a: argparse.Namespace) -> None:
    from millrace.operators import models

    rows = models.with_terms(session().read.parquet(a.input), "bytes")
    names = [r[0] for r in rows.select("major_label").distinct().collect()]
    models.train_linear(rows.where("split = 'train'") if "split" in rows.columns else rows, "major_label", sorted(names), a.kind).write().overwrite().save(a.output)


def predict(a: argparse.Namespace) -> None:
    """Flows with the class and the probabilities that a saved baseline gives them."""
    from millrace.operators import models
    from millrace.sources.sinks import write_predictions

    found = models.predicted(models.loaded(a.model), session().read.parquet(a.input), "bytes")
    write_predictions(found.drop("bytes"), a.output)


def predict_hex(a: argparse.Namespace) -> None:
    """One payload, given as hex text, through a saved baseline."""
    from millrace.functions.tokens import parsed_hex
    from millrace.operators import models

    one = session().createDataFrame([(a.payload,)], "payload string").select(parsed_hex(F.col("payload")).alias("bytes"))
    if one.where("bytes IS NULL").count():
        raise SystemExit("the payload is no hex text")
    print(json.dumps(models.predicted(models.loaded(a.model), one, "bytes").drop("bytes").first().asDict(recursive=True)))


def predict_pcap(a: argparse.Namespace) -> None:
    """A capture's flows through a saved baseline."""
    from millrace.operators import models
    from millrace.plans import build as b
    from millrace.sources import pcap
    from millrace.sources.sinks import write_predictions

    s = session()
    found = models.predicted(models.loaded(a.model), b.extract(pcap.read_packets(s, a.input), a.idle, a.cap), "bytes")
    write_predictions(found.drop("bytes", "packet_directions", "packet_lengths") if a.output.endswith(".csv") else found, a.output)


def evaluate(a: argparse.Namespace) -> None:
    from millrace.functions.labels import MAJORS
    from millrace.operators import metrics
    from millrace.sources.sinks import write_metrics

    df, labels = session().read.parquet(a.input), list(MAJORS)
    summary = metrics.major_metrics(df, "major_label", "pred_label", labels)
    if a.output:
        write_metrics(a.output, summary, metrics.per_class(df, "major_label", "pred_label", labels), metrics.confusion(df, "major_label", "pred_label", labels), metrics.detection(df, "major_label", "pred_label"), labels)
    print(json.dumps(summary.first().asDict()))


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="millrace")
    commands = top.add_subparsers(required=True)

    def command(fn, *arguments: tuple[str, dict]) -> None:
        p = commands.add_parser(fn.__name__.replace("_", "-"))
        for name, options in arguments:
            p.add_argument(name, **options)
        p.set_defaults(run=fn)

    one, out = ("input", {}), ("output", {})
    command(build, one, out, ("--idle", {"type": float, "default": 120.0}), ("--cap", {"type": int, "default": 32}), ("--closing", {"action": "store_true"}))
    command(split, one, out, ("--group", {"default": "flow_id"}), ("--stratum", {"default": "major_label"}), ("--method", {"default": "hash", "choices": ["hash", "time", "block"]}))
    command(merge, out, ("input", {"nargs": "+"}))
    command(stats, one)
    command(validate, one)
    command(vocab, out)
    command(codebook, one, out, ("--label", {}), ("--target", {}), ("--size", {"type": int, "default": 4}), ("--entries", {"type": int, "default": 256}), ("--least", {"type": int, "default": 2}))
    command(baseline, one, out, ("--kind", {"default": "logistic", "choices": ["logistic", "hinge"]}))
    model = ("--model", {"required": True})
    command(predict, one, out, model)
    command(predict_hex, ("payload", {}), model)
    command(predict_pcap, one, out, model, ("--idle", {"type": float, "default": 120.0}), ("--cap", {"type": int, "default": 32}))
    command(evaluate, one, ("--output", {}))
    a = top.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
