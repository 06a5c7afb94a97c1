"""Mixing sources to target weights, with a limit on repetition.

Token shares of the sources are tempered: q is proportional to the share raised to an exponent, which is bisected to
meet an entropy or so that no source has to be repeated more often than it may. Given target weights are met as they
are; a source that cannot reach its weight gives all it may, and the shares reached are reported. Weights become
document repeats by block permutations: whole passes over a source, and of one more pass whole blocks in a hashed
order up to the budget; only the block that crosses it is ranked document by document, so no source is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(source: Column) -> Column:
    """One spelling of a source name: lower case, trimmed, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def with_token_count(df: DataFrame, text: str, name: str = "tokens", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Add the number of tokens of df[text]; a null text has 0. The vocabulary is read once, on the driver, and travels with the tasks."""
    with open(tokenizer, "rb") as file:
        vocabulary = df.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
        encoding = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [0 if t is None else _encoded(encoding, t) for t in batch.column(text).to_pylist()]
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, name])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != text}
    return df.mapInArrow(count, ", ".join([*(f"`{c}` {t}" for c, t in types.items()), f"{name} long"]))


def _encoded(encoding, text: str, piece: int = 1 << 16) -> int:
    """Tokens of a text; a very long one is encoded in pieces that end before a blank, where no token crosses."""
    total, start = 0, 0
    while len(text) - start > piece:
        at = text.rfind(" ", start + 1, start + piece)
        while at > start and not (text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
            at = text.rfind(" ", start + 1, at)
        at = at if at > start else start + piece
        total += len(encoding.encode_ordinary(text[start:at]))
        start = at
    return total + len(encoding.encode_ordinary(text[start:]))


def tempered(sizes: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares proportional to size ** exponent; empty sources have none."""
    top = max(sizes.values(), default=0)
    raised = {s: (n / top) ** exponent if n else 0.0 for s, n in sizes.items()}
    total = sum(raised.values()) or 1.0
    return {s: x / total for s, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * log(p) for p in shares.values() if p > 0)


def exponent_for(sizes: dict[str, int], budget: float, max_repeats: dict[str, int], target_entropy: float | None = None) -> float:
    """The exponent in [0, 1] whose shares have the target entropy or, without one, the least that needs no source more often than allowed.

    Entropy falls and, for sources smaller than the mean, repetition falls as the exponent grows, so both are bisected;
    at 0 shares are even, at 1 every source is used once for a budget of all tokens.
    """

    def fits(exponent: float) -> bool:
        shares = tempered(sizes, exponent)
        return all(shares[s] * budget <= n * max_repeats.get(s, 1) * (1 + 1e-12) for s, n in sizes.items() if n)

    def bisect(ok) -> float:
        low, high = 0.0, 1.0
        if ok(low):
            return low
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if ok(middle) else (middle, high)
        return high

    return bisect(fits) if target_entropy is None else bisect(lambda x: entropy(tempered(sizes, x)) <= target_entropy)


@dataclass(frozen=True)
class Share:
    """What one source is asked for and may give, in tokens."""

    source: str
    weight: float
    max_repeats: int
    available: int
    documents: int
    budget: int

    @property
    def passes(self) -> int:
        return floor(self.budget / self.available) if self.available else 0

    @property
    def rest(self) -> int:
        return self.budget - self.passes * self.available


def shares_of(docs: DataFrame, targets: DataFrame, budget: int | None = None, tempering: bool = False) -> tuple[list[Share], int]:
    """Shares of all sources of `targets` (source, target_weight, max_repeats), which is small, and the tokens of all documents.

    With tempering, weights are the tempered token shares with the entropy of the target weights instead of the weights themselves.
    """
    wanted = {r.source: r for r in targets.select(source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").where("source IS NOT NULL AND target_weight IS NOT NULL").collect()}
    sums = docs.groupBy(F.when(F.col("source").isin(list(wanted)), F.col("source")).alias("source")).agg(F.sum("tokens").alias("n"), F.sum(F.when(F.col("tokens") > 0, 1).otherwise(0)).alias("docs"))
    held = {r.source: r for r in sums.collect()}
    everything = sum(r.n for r in held.values())
    budget = everything if budget is None else budget
    sizes = {s: held[s].n if s in held else 0 for s in wanted}
    repeats = {s: max(0, r.max_repeats if r.max_repeats is not None else 1) for s, r in wanted.items()}
    weights = {s: r.target_weight for s, r in wanted.items()}
    if tempering:
        weights = tempered(sizes, exponent_for(sizes, min(budget, sum(sizes.values())), repeats, entropy(weights)))
        budget = min(budget, sum(sizes.values()))
    out = []
    for s in sorted(wanted):
        most = sizes[s] * repeats[s]
        out.append(Share(s, weights[s], repeats[s], sizes[s], held[s].docs if s in held else 0, min(int(weights[s] * budget), most)))
    return out, everything


def repeats_of(docs: DataFrame, shares: list[Share], blocks: int = 1024, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, times) of every document that is used; `docs` has doc_id, source, tokens.

    No source exceeds its budget, and none falls short of it by more than the document that no longer fits.
    """
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s.source, s.passes, s.rest) for s in shares], "source string, passes long, rest long")
    hashed = docs.where("tokens > 0").join(F.broadcast(plan), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("block", F.pmod("h", F.lit(blocks)))
    sums = hashed.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    line = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block"), "block")
    starts = sums.withColumn("before", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = hashed.join(F.broadcast(starts), ["source", "block"])  # at most sources x blocks rows
    whole = placed.where("before + n <= rest").withColumn("extra", F.lit(1))
    crossing = placed.where("before < rest AND before + n > rest")
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut_block = crossing.withColumn("extra", F.when(F.col("before") + F.sum("tokens").over(within) <= F.col("rest"), 1).otherwise(0))
    later = placed.where("before >= rest").withColumn("extra", F.lit(0))
    used = whole.unionByName(cut_block).unionByName(later).withColumn("times", F.col("passes") + F.col("extra"))
    return used.where("times > 0").select("doc_id", "source", "tokens", "times")


def report(repeats: DataFrame, shares: list[Share], everything: int) -> DataFrame:
    """One row for each source: what was asked, what there is, and what was reached."""
    asked = repeats.sparkSession.createDataFrame(
        [(s.source, float(s.weight), s.max_repeats, s.documents, s.available, int(s.weight * everything), s.budget) for s in shares],
        "source string, target_weight double, max_repeats int, documents long, available_tokens long, target_tokens long, budget_tokens long",
    )
    used = repeats.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.max("times").alias("most_times"), F.sum("times").alias("used_documents"))
    out = asked.join(used, "source", "left").na.fill(0, ["used_tokens", "most_times", "used_documents"])
    mixed = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("share_of_all", F.col("used_tokens") / F.lit(max(1, everything))).withColumn("share_of_mix", F.col("used_tokens") / F.greatest(mixed, F.lit(1))).withColumn("reached", F.col("budget_tokens") >= F.col("target_tokens"))
