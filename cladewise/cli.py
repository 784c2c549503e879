"""python -m cladewise COMMAND: download, build, augment, prepare, cache, search, train."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Sequence
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import storage
from .functions.schema import LEVELS, Oversampling, Training
from .operators import labels, metrics, trainer, training, tuning
from .plans import build as plan
from .sources import remote
from .sources.fasta import DataError
from .sources.registry import SOURCES, TAXONOMY

LOG = logging.getLogger("cladewise")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladewise")
    top.add_argument("-v", "--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("download", "build", "augment", "prepare", "cache", "search", "train"):
        c = commands.add_parser(name)
        c.add_argument("--data-dir", default="data")
        if name in ("cache", "search", "train"):
            c.add_argument("--min-class-count", type=int, default=3)
        if name in ("search", "train"):
            c.add_argument("--epochs", type=int, default=6 if name == "search" else 10)
            c.add_argument("--batch-size", type=int, default=128)
            c.add_argument("--validation-samples", type=int, default=20_000 if name == "search" else 50_000)
            c.add_argument("--hours", type=float)
            c.add_argument("--seed", type=int, default=20260923)
            c.add_argument("--output")
            c.add_argument("--architecture", choices=("kmer", *sorted(tuning.SPACES)), default="kmer")
            c.add_argument("--samples-per-epoch", type=int)
            c.add_argument("--workers", type=int, choices=(1, 2, 4, 8), default=1, help="tasks that share a batch")
        if name == "search":
            c.add_argument("--trials", type=int, default=30)
            c.add_argument("--together", type=int, default=1, help="trials at once")
            c.add_argument("--storage", help="the search's journal")
        if name == "train":
            c.add_argument("--params", required=True)
            c.add_argument("--trial", type=int)
            c.add_argument("--resume", action="store_true")
            c.add_argument("--log-every", type=int, default=500)
    return top


def session() -> SparkSession:
    return SparkSession.builder.appName("cladewise").getOrCreate()


def main(argv: Sequence[str] | None = None, opener: remote.Opener = remote.https, sources: Sequence[remote.Source] = SOURCES, taxonomy: remote.Source | None = TAXONOMY, build: plan.Build | None = None, oversampling: Oversampling | None = None) -> int:
    """0 if all went well, 1 on an error of the data, 2 on wrong arguments."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    layout = plan.Layout(str(Path(args.data_dir).absolute()))
    every = [*sources, *([taxonomy] if taxonomy else [])]
    try:
        if args.command in ("download", "prepare"):
            plan.download(layout, every, opener)
        if args.command in ("build", "prepare"):
            plan.need_files(layout, every)
            plan.build(session(), layout, build or plan.Build(sources, taxonomy))
        if args.command in ("augment", "prepare"):
            plan.need_dataset(layout)
            plan.augment(session(), layout, oversampling or Oversampling())
        if args.command == "cache":
            plan.need_dataset(layout, layout.synthetic)
            LOG.info("rows: %s", plan.cache(session(), layout, args.min_class_count))
        if args.command in ("search", "train"):
            plan.need_dataset(layout, layout.synthetic)
            _learn(session(), layout, args)
    except (DataError, remote.DownloadError, ValueError, OSError) as e:
        LOG.error("%s", e)
        return 1
    return 0


def _learn(spark: SparkSession, layout: plan.Layout, args: argparse.Namespace) -> None:
    data = plan.load_training(spark, layout, args.min_class_count, args.validation_samples, args.seed)
    sizes = {r["level"]: r["n"] for r in labels.level_sizes(data["space"]).collect()}  # a row for each level
    widths = [max(1, sizes.get(n, 0)) for n in LEVELS]
    deadline = time.monotonic() + args.hours * 3600 if args.hours else float("inf")
    config = Training(epochs=args.epochs, batch_size=args.batch_size, seed=args.seed, samples=args.samples_per_epoch)
    folder = args.output or f"{layout.top}/models/{args.command}"
    if args.architecture != "kmer":
        _learn_encoder(spark, data, tuple(widths), config, deadline, folder, args)
        return
    held = training.prepared(data["validation"])

    def fit(c: Training, watch, resume: bool = False, into: str | None = None):
        return training.fit(training.prepared(data["train"], power=c.sampling_power), held, widths, c, into, watch=watch, resume=resume, deadline=deadline)

    if args.command == "search":
        training.search(lambda c, watch: fit(c, watch)[1], config, folder, args.trials, args.seed, deadline=deadline)
        return
    config = replace(config, **training.choice(args.params, args.trial), log_every=args.log_every)
    params, history = fit(config, lambda e: LOG.info("epoch %d: loss %.4f, val_loss %.4f %s", e.epoch, e.loss, e.val_loss, training.bar(e.epoch, config.epochs)), args.resume, folder)
    import pyspark.sql.functions as F

    targets = F.array(*(F.col(f"y_{n}").cast("int") for n in LEVELS))
    rows = data["validation"].select("seq_hash", training.kmer_shares("sequence").alias("features"), targets.alias("targets"))
    _report(data["validation"], training.predictions(rows, params, len(LEVELS)), folder)
    LOG.info("%d epochs", len(history))


def _learn_encoder(spark: SparkSession, data: dict, sizes: tuple[int, ...], config: Training, deadline: float, folder: str, args: argparse.Namespace) -> None:
    if args.command == "search":
        journal = args.storage or f"{folder}/{args.architecture.lower()}.journal"
        asked = tuning.Search(args.trials, args.hours * 3600 if args.hours else None, args.epochs, together=args.together, seed=args.seed)
        tuning.search_encoders(data["train"], data["validation"], sizes, args.architecture, config, journal, asked, workers=args.workers)
        return
    encoder, heads, told = tuning.setup(training.choice(args.params, args.trial), args.architecture, sizes, replace(config, log_every=args.log_every))

    def on_steps(epoch: int, step: int, loss: float, speed: float, lr: float) -> None:
        LOG.info("epoch %d: step %d, loss %.4f, %.0f sequences/s, lr %.2e", epoch, step, loss, speed, lr)

    def watch(r: trainer.Record) -> bool:
        LOG.info("epoch %d done in %s: val loss %.4f, genus %.3f, species %.3f %s", r.epoch, training.duration(r.seconds), r.val_loss, r.accuracy["genus"], r.accuracy["species"], training.bar(r.epoch, told.epochs))
        return False

    w, history = trainer.train(data["train"], data["validation"], encoder, heads, told, folder, workers=args.workers, resume=args.resume, watch=watch, on_steps=on_steps, deadline=deadline)
    _report(data["validation"], trainer.predictions(data["validation"], w, trainer.Net(encoder, heads), told.max_length), folder)
    LOG.info("%d epochs", len(history))


def _report(rows: DataFrame, said: DataFrame, folder: str) -> None:
    """Report.json and report.txt, by marker where there is one."""
    import pyspark.sql.functions as F

    extra = ["marker"] if "marker" in rows.columns else []
    said = said.join(rows.select("seq_hash", *extra), "seq_hash")
    said = said if extra else said.withColumn("marker", F.lit("all"))
    report = [r.asDict() for r in metrics.group_reports(said).collect()] if extra else [r.asDict() for r in metrics.level_report(metrics.class_counters(said)).collect()]
    report.sort(key=lambda r: (r.get("marker", ""), LEVELS.index(r["level"])))
    storage.write_json(Path(folder) / "report.json", report)
    storage.write_text(Path(folder) / "report.txt", training.table(report) + "\n")


if __name__ == "__main__":
    sys.exit(main())
