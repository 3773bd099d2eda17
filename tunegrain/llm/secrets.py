"""Secrets in texts: three fixed patterns, and strings that look random.

First-order Markov models of characters, one of random strings and one of ordinary
identifiers, are compared by their log-likelihood ratio. Both are trained from labelled samples:
values found by the fixed patterns against other words of the same alphabet. Everything runs as
DataFrame expressions; only the table of weights (a square of the alphabet) meets the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm.columns import unused
from tunegrain.runtime import broadcast_within, materialize

# The patterns of the base kinds, and the least lengths of what they find.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # whole runs of [0-9a-f] of 24 and more
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE_TEXTS = 20_000  # texts whose words and values are learned from, about
SMOOTHING = 1.0
LEAST_RATIO = 12.0  # nats by which the random model must win
UNIT = 1_000  # weights are whole thousandths of a nat, so sums are exact


def _matches(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _random_value(word: Column) -> Column:
    """A candidate needs a letter; digits alone are numbers."""
    return word.rlike("[A-Za-z]")


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> list[int]:
    """Log-likelihood ratios of character pairs, a flat square over ALPHABET and one further character.

    Learns from about `sample_texts` texts, chosen by a hash of row values. Values of the base kinds are
    the random sample, words of eight and more letters the ordinary one, each once. Samples without
    values leave only the smoothing, so that nothing is judged random.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.count()
    cut = min(1_000_003, -(-1_000_003 * sample_texts // max(total, 1)))
    chosen = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < cut)
    values = F.concat(
        F.transform(_matches("text", ASSIGN), _value), _matches("text", ACCESS), _matches("text", HEX),
    )
    words = F.filter(_matches("text", CANDIDATE.replace("16", "8")), lambda w: ~w.rlike("[0-9+/_=-]"))
    sample = chosen.select(F.explode(F.array(
        F.struct(F.lit(1).alias("y"), values.alias("v")), F.struct(F.lit(0).alias("y"), words.alias("v"))
    )).alias("s")).select("s.y", F.explode("s.v").alias("word")).filter(
        (F.col("y") == 0) | (F.length("word") >= ASSIGN_LENGTH)
    ).distinct()
    # a word that is both is a value
    sample = sample.groupBy("word").agg(F.max("y").alias("y"))
    pair = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counts = sample.filter(F.length("word") > 1).select("y", F.explode(pair).alias("pair")).groupBy("y", "pair").count().collect()
    size = len(ALPHABET) + 1
    tables = {y: [[SMOOTHING] * size for _ in range(size)] for y in (0, 1)}
    for row in counts:
        if len(row["pair"]) == 2:
            a, b = (ALPHABET.find(c) % size for c in row["pair"])
            tables[row["y"]][a][b] += row["count"]
    return [
        round(UNIT * (math.log(tables[1][a][b] / sum(tables[1][a])) - math.log(tables[0][a][b] / sum(tables[0][a]))))
        for a in range(size) for b in range(size)
    ]


def log_ratio(word: Column, weights: list[int]) -> Column:
    """Sum of the weights of all character pairs of `word`, in thousandths of a nat."""
    size = len(ALPHABET) + 1
    table = F.array(*[F.lit(w) for w in weights])
    letters = F.transform(F.split(word, ""), lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1 + size, F.lit(size)))

    def add(total, i):
        return total + F.element_at(table, F.element_at(letters, i) * size + F.element_at(letters, i + 1) + 1)

    return F.when(
        F.length(word) > 1, F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0), add)
    ).otherwise(0)


def _pieces(kind: int, pattern: str, keep) -> Column:
    """Matches of a kind with the text before each, as structs (kind, i, before, length, ok)."""
    found = _matches("text", pattern)
    between = F.split("text", pattern, -1)
    return F.when(
        F.size(found) > 0,
        F.transform(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")), lambda p, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(p["b"]).alias("before"), F.length(p["m"]).alias("length"),
            keep(p["m"]).alias("ok"),
        )),
    ).otherwise(F.array().cast("array<struct<kind:int,i:int,before:int,length:int,ok:boolean>>"))


def find_secrets(docs: DataFrame, weights: list[int]) -> DataFrame:
    """Spans of every row: row, doc_id, text_hash, kind, start, end (exclusive), in code points.

    kind is a place in KINDS; a row without spans has one line of kind -1. Spans of the base
    kinds are kept as found; random strings are added where they meet no base span. Null texts
    count as empty; other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    always = F.lit(True)
    none = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("before"), F.lit(0).alias("length"), F.lit(True).alias("ok")))
    kinds = F.concat(
        none,
        _pieces(0, ASSIGN, lambda m: F.length(_value(m)) >= ASSIGN_LENGTH),
        _pieces(1, ACCESS, lambda m: F.length(m) >= ACCESS_LENGTH),
        _pieces(2, HEX, lambda m: always),
        _pieces(3, CANDIDATE, lambda m: _random_value(m) & (log_ratio(m, weights) >= round(LEAST_RATIO * UNIT))),
    )
    # what fails still moves the places of the kind's later matches
    pieces = materialize(texts.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), F.inline(kinds)), "matches")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(upto)
    spans = pieces.withColumn("end", end).filter("ok").select(
        "row", "doc_id", "text_hash", "kind", (F.col("end") - F.col("length")).alias("start"), "end"
    )
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 3
    last = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.min(F.when(base & (F.col("kind") >= 0), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(last, F.lit(-1)) <= F.col("start")) & (F.coalesce(next_, F.lit(2**62)) >= F.col("end"))
    return spans.withColumn("free", free).filter(base | F.col("free")).drop("free")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def scan_secrets(docs: DataFrame, weights: list[int]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; rows without spans have the empty list."""
    item = F.struct("start", "kind", "end")
    real = F.col("kind") >= 0
    return (
        find_secrets(docs, weights).groupBy("row", "doc_id").agg(
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(_joined(F.collect_list(F.when(real & (F.col("kind") < 3), item))).cast("binary"), 256).alias("base_sha256"),
            _joined(F.collect_list(F.when(real, item))).alias("spans"),
        ).drop("row")
    )


def redact(docs: DataFrame, weights: list[int], mark: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans by one) and n_chars counted again; all rows and columns stay."""
    spans = find_secrets(docs, weights).filter("kind >= 0").groupBy("row", "doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    # equal texts have equal spans
    id_, hash_, found = unused(docs, "span_id", "span_hash", "found_spans")
    spans = spans.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(found)).dropDuplicates([id_, hash_])
    spans = materialize(spans, "spans")
    spans = broadcast_within(spans, spans.count())
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_)), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(done, span):
        apart = span["start"] >= done["at"]
        gap = F.col("text").substr((done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        out = F.when(apart, F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    def finish(done):
        return F.concat(done["out"], F.col("text").substr((done["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.aggregate(found, start, put, finish))
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*docs.columns)
