"""Fixed values of the data model: ranks, levels, kingdoms, markers, reasons, defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
LEVELS = ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")
KINGDOMS = ("Bacteria", "Archaea", "Animalia", "Fungi", "Plantae", "Protista")
EXCLUSIONS = ("malformed_header", "invalid_sequence", "off_target", "organelle", "too_short", "too_long", "too_ambiguous")
SPLITS = ("train", "val", "test", "test_novel_genus")
#: Inclusive bounds of the length of each marker's sequences.
MARKERS = {"ssu": (500, 4000), "coi": (400, 2500), "its": (300, 1500), "rbcl": (400, 1600), "matk": (400, 1800)}
NUCLEOTIDES = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"
UNKNOWN = "unknown"
IGNORED = -100

STAGING = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("accession", T.StringType(), False),
        T.StructField("seq_hash", T.BinaryType(), False),
        T.StructField("sequence", T.StringType(), False),
        T.StructField("length", T.IntegerType(), False),
        T.StructField("n_ambiguous", T.IntegerType(), False),
        T.StructField("source_lineage", T.ArrayType(T.StringType()), False),
        *(T.StructField(r, T.StringType()) for r in RANKS),
        T.StructField("kingdom", T.StringType()),
        T.StructField("marker", T.StringType(), False),
    ]
)
MERGED = ("seq_hash", "sequence", "length", "n_ambiguous", "marker", "domain", "kingdom", *RANKS[1:], "sources", "accessions", "n_records", "label_conflict")


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


@dataclass(frozen=True)
class Filters:
    """Bounds that a record must keep to; markers without bounds of their own take min_length and max_length."""

    min_length: int = 500
    max_length: int = 4000
    max_ambiguous: float = 0.01
    by_marker: tuple[tuple[str, int, int], ...] = tuple((m, *b) for m, b in MARKERS.items() if m != "ssu")

    def __post_init__(self) -> None:
        for low, high in [(self.min_length, self.max_length), *((a, b) for _, a, b in self.by_marker)]:
            _need(1 <= low <= high, f"lengths must satisfy 1 <= {low} <= {high}")
        _need(0 <= self.max_ambiguous <= 1, "max_ambiguous must lie in [0, 1]")


@dataclass(frozen=True)
class Split:
    validation: float = 0.05
    test: float = 0.05
    novel_genus: float = 0.05
    min_novel_genus_size: int = 3
    seed: int = 20260922

    def __post_init__(self) -> None:
        for share in (self.validation, self.test, self.novel_genus):
            _need(0 <= share < 1, "shares must lie in [0, 1)")
        _need(self.validation + self.test < 1, "validation and test must leave rows to train on")
        _need(self.min_novel_genus_size >= 1, "min_novel_genus_size must be positive")
        _need(0 <= self.seed < 2**64, "the seed must fit 64 bits")


@dataclass(frozen=True)
class Mutation:
    substitution: float = 0.005
    insertion: float = 0.001
    deletion: float = 0.001
    crop_probability: float = 0.0
    crop_min: int = 150
    crop_max: int = 500
    reverse_complement: float = 0.0

    def __post_init__(self) -> None:
        for p in (self.substitution, self.insertion, self.deletion, self.crop_probability, self.reverse_complement):
            _need(0 <= p <= 1, "probabilities must lie in [0, 1]")
        _need(1 <= self.crop_min <= self.crop_max, "crop bounds must satisfy 1 <= min <= max")


@dataclass(frozen=True)
class Oversampling:
    rank: str = "genus"
    floor: int = 20
    max_copies: int = 5
    max_ratio: float = 1.0
    seed: int = 20260922
    mutation: Mutation = Mutation()

    def __post_init__(self) -> None:
        _need(self.rank in RANKS, f"{self.rank} is no rank")
        _need(self.floor >= 1, "floor must be positive")
        _need(self.max_copies >= 0, "max_copies can't be negative")
        _need(0 < self.max_ratio <= 1, "max_ratio must lie in (0, 1]")
        _need(0 <= self.seed < 2**64, "the seed must fit 64 bits")


@dataclass(frozen=True)
class Training:
    epochs: int = 8
    batch_size: int = 128
    max_length: int = 2048
    learning_rate: float = 3e-4
    weight_decay: float = 0.05
    warmup: float = 0.05
    clip: float = 1.0
    sampling_power: float = 0.5
    eval_batch: int = 256
    bucket_window: int = 64
    log_every: int = 500
    seed: int = 20260923
    samples: int | None = None
    crop_probability: float = 0.5
    crop_min: int = 150
    crop_max: int = 500

    def __post_init__(self) -> None:
        _need(self.samples is None or self.samples >= 1, "samples must be positive")
        _need(0 <= self.crop_probability <= 1 and 1 <= self.crop_min <= self.crop_max, "crops need a probability in [0, 1] and 1 <= crop_min <= crop_max")
        _need(min(self.epochs, self.batch_size, self.max_length, self.eval_batch, self.bucket_window, self.log_every) >= 1, "sizes must be positive")
        _need(self.learning_rate > 0 and self.weight_decay >= 0 and self.clip > 0, "rates must be positive")
        _need(0 <= self.seed < 2**64, "the seed must fit 64 bits")
        _need(0 <= self.warmup < 1 and 0 <= self.sampling_power <= 1, "warmup and sampling_power must lie in [0, 1]")
