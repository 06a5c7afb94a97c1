"""Splitting of oversized items at natural boundaries, by ranges.

No worker needs a whole item: an item is a sequence of ranges, each with a short halo of the text before it. Workers
count the tokens that start in a range; prefix sums stitch the counts to global token numbers; workers then report,
for each cell of the token line, the best boundary they see; the best of all ranges is the cut. With L = limit -
overlap, cells have H = L / (1 + slack) tokens and a cut lies in the last L - H tokens of its cell, so two
neighbouring cuts are at most L tokens apart and no cut depends on the one before. Pieces are then read by offset.
An item of one range needs no stitching and is cut by its worker alone. Where a range begins, white space and sentence
marks are seen HALO characters back.

A token is a run of characters other than space, tab, carriage return and line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions.text import content_digest

HALO = 256
_TOKEN = re.compile(r"[^ \t\r\n]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[,;:–—][\"'”’»)\]]*$")


def boundary_rank(before: str, gap: str) -> int:
    """How natural a cut is after the token `before` and within the white space `gap`: paragraph, line, sentence, clause, word."""
    if _PARAGRAPH.search(gap):
        return 4
    if "\n" in gap or "\r" in gap:
        return 3
    if _SENTENCE.search(before):
        return 2
    return 1 if _CLAUSE.search(before) else 0


def text_ranges(df: DataFrame, key: str, text: str, range_chars: int) -> DataFrame:
    """(key, range_no, offset, halo, body) of texts held in a column; offsets are zero-based characters."""
    t = F.col(f"`{text}`")
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / range_chars).cast("int")))
    at = F.col("range_no") * range_chars
    left = F.least(at, F.lit(HALO))
    return df.where(F.length(t) > 0).select(F.col(key), t.alias("__t"), F.explode(numbers).alias("range_no")).select(
        key,
        "range_no",
        at.cast("long").alias("offset"),
        F.substring("__t", at - left + 1, left).alias("halo"),
        F.substring("__t", at + 1, F.lit(range_chars)).alias("body"),
    )


def file_ranges(spark: SparkSession, paths: DataFrame, range_bytes: int) -> DataFrame:
    """(item_key, range_no, offset, halo, body) of UTF-8 files; `paths` has path (a URI of a file system that all workers reach, or a shared folder) and n_bytes.

    Each worker reads only its byte range and the halo before it, moved to the next character start; offsets are bytes.
    """
    from pyarrow import fs

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, n, size in zip(batch.path, batch.range_no, batch.n_bytes, strict=True):
                start, end = n * range_bytes, min((n + 1) * range_bytes, size)
                system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with system.open_input_file(place) as file:
                    file.seek(low := max(0, start - 4 * HALO))
                    raw = file.read(end + 3 - low)
                a, b = start - low, end - low
                while a < len(raw) and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b += 1
                rows.append((path, n, low + a, raw[:a].decode(errors="ignore")[-HALO:], raw[a:b].decode(errors="replace")))
            yield pd.DataFrame(rows, columns=["item_key", "range_no", "offset", "halo", "body"])

    last = F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / range_bytes).cast("int"))
    numbered = paths.select("path", "n_bytes", F.explode(F.sequence(F.lit(0), last)).alias("range_no")).repartition("path", "range_no")
    return numbered.mapInPandas(read, "item_key string, range_no int, offset long, halo string, body string")


def _starts(halo: str, body: str) -> list[re.Match]:
    """Tokens that start in the body: one that runs on from the halo started before."""
    found = list(_TOKEN.finditer(body))
    if found and found[0].start() == 0 and halo and halo[-1] not in " \t\r\n":
        del found[0]
    return found


def _count_tokens(halo: Column, body: Column) -> Column:
    runs = F.size(F.regexp_extract_all(body, F.lit(r"[^ \t\r\n]+"), F.lit(0)))
    joined = halo.rlike(r"[^ \t\r\n]\z") & body.rlike(r"^[^ \t\r\n]")
    return runs - F.when(joined, 1).otherwise(0)


def token_bases(ranges: DataFrame, key: str) -> DataFrame:
    """(key, range_no, base, tokens, total): prefix sums of the tokens that start in each range."""
    counted = ranges.select(key, "range_no", _count_tokens(F.col("halo"), F.col("body")).cast("long").alias("tokens"))
    line = Window.partitionBy(key).orderBy("range_no")
    running = F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("base", running - F.col("tokens")).withColumn("total", F.sum("tokens").over(Window.partitionBy(key)))


def _grid(limit: Column, overlap: Column, slack: float) -> dict[str, Column]:
    """Cells begin `shared` tokens into the item, so that the first piece may be as long as the others."""
    span = limit - overlap
    cell = F.greatest(F.lit(1), F.floor(span / (1 + slack))).cast("int")
    return {"shared": overlap, "span": span, "cell": cell, "reach": F.least(span - cell, cell - 1)}


def _usable(df: DataFrame) -> DataFrame:
    """Rows with a limit and an overlap that can be met; a null or negative overlap is none."""
    shared = F.greatest(F.coalesce(F.col("overlap"), F.lit(0)), F.lit(0)).cast("int")
    return df.withColumn("limit", F.col("limit").cast("int")).withColumn("overlap", shared).where("limit > 0 AND overlap < limit")


def split_text(text: str, limit: int, overlap: int, slack: float = 0.25) -> list[tuple[int, int, int, int, int, str]]:
    """(piece_no, start_token, end_token, token_count, start_offset, text) of one item that a worker holds whole: the same cells and cuts as by ranges."""
    starts, ends = [], []
    for m in _TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    total = len(starts)
    if not total:
        return []
    span = limit - overlap
    cell = max(1, int(span / (1 + slack)))
    reach = min(span - cell, cell - 1)
    cuts = 0 if total <= limit else -(-(total - overlap - span + reach) // cell)
    edges = []
    for g in range(cuts):
        last = overlap + (g + 1) * cell
        choice = (boundary_rank(text[max(0, ends[n - 1] - 8) : ends[n - 1]], text[ends[n - 1] : starts[n]]) * (1 << 32) + n for n in range(last - reach, min(last, total - 1) + 1))
        edges.append(max(choice) & ((1 << 32) - 1))
    out = []
    for g, (first, last) in enumerate(zip([0, *(e - overlap for e in edges)], [*edges, total], strict=True)):
        out.append((g, first, last, last - first, starts[first], text[starts[first] if g else 0 : ends[last - 1]]))
    return out


def split_ranges(ranges: DataFrame, limits: DataFrame, key: str, slack: float = 0.25) -> DataFrame:
    """(key, piece_no, start_token, end_token, token_count, start_offset, text) of all items of `limits` (key, limit, overlap).

    Items within the limit give one piece, longer ones pieces of at most `limit` tokens; neighbouring pieces share
    exactly `overlap` tokens, and a cut never lies within a token. Items without a token, with a null or non-positive
    limit, or with an overlap of the limit or more, which no cut can meet, give no piece.
    """
    wanted = _usable(limits.select(key, "limit", "overlap"))
    grid = wanted.select(key, "limit", *[c.alias(n) for n, c in _grid(F.col("limit"), F.col("overlap"), slack).items()])
    bases = token_bases(ranges, key).join(grid, key).withColumn(
        "cuts", F.when(F.col("total") <= F.col("limit"), 0).otherwise(F.ceil((F.col("total") - F.col("shared") - F.col("span") + F.col("reach")) / F.col("cell")))
    )
    placed = ranges.join(bases, [key, "range_no"])

    def boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, halo, body, base, cell, reach, cuts, shared in batch[["item_key", "halo", "body", "base", "cell", "reach", "cuts", "shared"]].itertuples(index=False):
                best: dict[int, tuple[int, int]] = {}
                text, shift = halo + body, len(halo)
                tokens = list(_TOKEN.finditer(text))
                number = base - 1
                for i, token in enumerate(tokens):
                    if token.start() < shift:
                        continue
                    number += 1
                    g = -(-(number - shared) // cell) - 1
                    if g < 0 or g >= cuts or shared + (g + 1) * cell - number > reach:
                        continue
                    end = tokens[i - 1].end() if i else 0
                    mark = (boundary_rank(text[max(0, end - 8) : end], text[end : token.start()]), number)
                    best[g] = max(best.get(g, mark), mark)
                rows += [(k, g, *mark) for g, mark in best.items()]
            yield pd.DataFrame(rows, columns=["item_key", "cell_no", "rank", "cut"])

    seen = placed.where("cuts > 0").select(F.col(key).alias("item_key"), "halo", "body", "base", "cell", "reach", "cuts", "shared")
    cuts = (
        seen.mapInPandas(boundaries, "item_key string, cell_no long, rank int, cut long")
        .groupBy("item_key", "cell_no")
        .agg(F.max(F.struct("rank", "cut"))["cut"].alias("cut"))
    )
    items = bases.where("range_no = 0").select(F.col(key).alias("item_key"), "total", "shared", "cuts").where("total > 0")
    ends = items.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts"))).alias("piece_no"))
    own = cuts.select("item_key", F.col("cell_no").alias("piece_no"), F.col("cut").alias("end_cut"))
    line = Window.partitionBy("item_key").orderBy("piece_no")
    pieces = ends.join(own, ["item_key", "piece_no"], "left").select(
        "item_key",
        "piece_no",
        F.coalesce(F.lag("end_cut").over(line) - F.col("shared"), F.lit(0)).cast("long").alias("start_token"),
        F.coalesce("end_cut", "total").cast("long").alias("end_token"),
    )
    spread = placed.select(F.col(key).alias("item_key"), "range_no", "base", "tokens", "cell", "cuts", "shared").select(
        "item_key",
        "range_no",
        "base",
        "tokens",
        F.explode(
            F.sequence(
                # A piece ends within the cell of its number and begins a cell and the overlap before that.
                F.least(F.col("cuts"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("base") - F.col("shared")) / F.col("cell")) - 1)),
                F.least(F.col("cuts"), F.floor((F.col("base") + F.col("tokens")) / F.col("cell")) + 1),
            )
        ).alias("piece_no"),
    )
    touching = (
        spread.join(pieces, ["item_key", "piece_no"])
        .where("start_token <= base + tokens AND end_token > base - 1")
        .groupBy("item_key", "range_no")
        .agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_token", "end_token"))).alias("pieces"))
    )
    carried = touching.join(placed.select(F.col(key).alias("item_key"), "range_no", "offset", "halo", "body", "base"), ["item_key", "range_no"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["item_key", "piece_no", "start_token", "end_token", "range_no", "start_offset", "part"]
        for batch in batches:
            rows = []
            for k, n, offset, halo, body, base, pieces in batch[["item_key", "range_no", "offset", "halo", "body", "base", "pieces"]].itertuples(index=False):
                tokens = _starts(halo, body)
                for p in pieces:
                    first, last = p["start_token"] - base, p["end_token"] - base
                    begin = 0 if first < 0 else tokens[first].start() if first < len(tokens) else len(body)
                    # The last token may run on into the next range; there its rest is what precedes the first token start.
                    end = tokens[last].start() if 0 <= last < len(tokens) else len(body)
                    if last == 0 and tokens:
                        end = tokens[0].start()
                    if begin < end or (first >= 0 and first < len(tokens)):
                        rows.append((k, p["piece_no"], p["start_token"], p["end_token"], n, offset + begin, body[begin:end]))
            yield pd.DataFrame(rows, columns=columns)

    schema = "item_key string, piece_no long, start_token long, end_token long, range_no int, start_offset long, part string"
    joined = (
        carried.mapInPandas(parts, schema)
        .groupBy("item_key", "piece_no", "start_token", "end_token")
        .agg(
            F.min("start_offset").alias("start_offset"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "part"))), lambda x: x["part"]), "").alias("text"),
        )
    )
    return joined.select(
        F.col("item_key").alias(key),
        "piece_no",
        "start_token",
        "end_token",
        (F.col("end_token") - F.col("start_token")).alias("token_count"),
        "start_offset",
        F.rtrim("text", F.lit(" \t\r\n")).alias("text"),
    )


def split_items(df: DataFrame, item: list[str], text: str, limit: str, overlap: str, range_chars: int = 1 << 16, slack: float = 0.25) -> DataFrame:
    """(*item, piece_no, start_token, end_token, token_count, start_offset, text) for a text column.

    Texts of up to range_chars characters are one range and cut where they are; longer ones are spread over the
    workers by ranges, with the same cuts. Repeated rows (same item, text, limit and overlap) are one item; the same
    item with another text is cut for itself. Null or blank texts, null limits, and overlaps of the limit or more give
    no piece; other columns of any name are not looked at.
    """
    key = "item_key"
    picked = df.select(*[F.col(f"`{c}`") for c in item], F.col(f"`{text}`").alias("__text"), F.col(f"`{limit}`").alias("limit"), F.col(f"`{overlap}`").alias("overlap"))
    picked = _usable(picked.where("__text IS NOT NULL"))
    keyed = picked.withColumn(key, content_digest(*[F.col(f"`{c}`") for c in item], F.col("__text"), F.col("limit"), F.col("overlap")))
    names = [F.col(f"`{c}`") for c in item]

    def cut_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*own, *piece) for *own, t, size, shared in batch.itertuples(index=False) for piece in split_text(t, size, shared, slack)]
            yield pd.DataFrame(rows, columns=columns)

    columns = [*item, "piece_no", "start_token", "end_token", "token_count", "start_offset", "text"]
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in item), "piece_no long, start_token long, end_token long, token_count long, start_offset long, text string"])
    short = keyed.where(F.length("__text") <= range_chars).dropDuplicates([key])
    whole = short.select(*names, "__text", "limit", "overlap").mapInPandas(cut_whole, schema)
    long = keyed.where(F.length("__text") > range_chars).dropDuplicates([key])
    pieces = split_ranges(text_ranges(long, key, "__text", range_chars), long.select(key, "limit", "overlap"), key, slack)
    return whole.unionByName(long.select(key, *names).join(pieces, key).drop(key))
