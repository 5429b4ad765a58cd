"""Secret scan: fixed patterns, and strings that a pair of character Markov models finds random.

DataFrame functions only. A pattern's matches are taken with regexp_extract_all and what lies between them with
split on the same pattern, so that running sums of lengths give each match's place in code points. The two
first-order Markov models (random strings, ordinary identifiers) are counted on labelled samples: what the
fixed patterns match in the training rows, and the words of these rows outside all matches. The training rows are a sample
by the doc_id's hash, of TRAIN_DOCS rows on average. A string of TOKEN is a further span (kind markov) if it overlaps
no base span, has a letter, and a digit or letters of both cases, its mean log-likelihood ratio per character is
over MIN_RATIO, and their sum over MIN_SUM (over MIN_SUM_LETTERS without a digit), so that short strings have to be the
more random. '/', '=' and '.' end a string: what a path or a pair joins is judged piece by piece. Time is linear in a
string's length: characters are taken apart once.

Edge cases: a null text counts as empty; no spans give counts of 0 and the digest of an empty string; without
labelled samples both models are uniform and add nothing; rows repeated with one doc_id each give a row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

#: Fixed values of the contract.
KEYWORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN = rf"""(?i:{KEYWORD})\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: Greedy runs of one class: a shorter run can't hold a match, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs of 12 or more with a digit, or a capital that isn't the first character.
TOKEN = r"(?<![A-Za-z0-9+_-])(?=[A-Za-z+_-]*+[0-9]|[A-Za-z0-9+_-][a-z0-9+_-]*+[A-Z])[A-Za-z0-9+_-]{12,}+"
WORD = r"[A-Za-z_][A-Za-z0-9_-]{4,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Index 0 stands for any other character.
SYMBOLS = len(ALPHABET) + 1
TRAIN_DOCS = 20_000
MIN_RATIO = 0.4
MIN_SUM = 8.0
MIN_SUM_LETTERS = 20.0
_CHUNK = 256


def _lengths(df: DataFrame, kind: str, pattern: str, guard: str | None = None, group: int = 0) -> DataFrame:
    """Adds {kind}_m (matches), {kind}_g (their group) and {kind}_p (what stands before each), null where none."""
    text = F.col("text")
    df = df.withColumn(f"{kind}_m", F.when(text.rlike(guard or pattern), F.regexp_extract_all(text, F.lit(pattern), 0)))
    some = F.size(f"{kind}_m") > 0
    if group:
        df = df.withColumn(f"{kind}_g", F.when(some, F.regexp_extract_all(text, F.lit(pattern), group)))
    return df.withColumn(f"{kind}_p", F.when(some, F.slice(F.split(text, pattern, -1), 1, F.size(f"{kind}_m"))))


def _placed(df: DataFrame, kind: str) -> DataFrame:
    """Adds {kind}_s: an array of (start, kind's index, end, match, group) for the matches."""
    m, p, n = f"{kind}_m", f"{kind}_p", f"{kind}_n"
    df = df.withColumn(n, F.expr(f"zip_with({p}, {m}, (a, b) -> length(a) + length(b))"))
    chunks = f"sequence(0, (size({n}) - 1) div {_CHUNK})"
    piece = f"slice({n}, c * {_CHUNK} + 1, {_CHUNK})"
    df = df.withColumn(f"{kind}_c", F.expr(f"transform({chunks}, c -> aggregate({piece}, 0, (a, x) -> a + x))"))
    grow = "concat(a.o, array(a.t))), a -> a.o"
    df = df.withColumn(
        f"{kind}_b",
        F.expr(f"aggregate({kind}_c, named_struct('t', 0, 'o', cast(array() as array<int>)), (a, x) -> named_struct('t', a.t + x, 'o', {grow})"),
    )
    df = df.withColumn(
        f"{kind}_o",
        F.expr(
            f"flatten(transform({chunks}, c -> aggregate({piece}, named_struct('t', {kind}_b[c], 'o', cast(array() as array<int>)), (a, x) -> named_struct('t', a.t + x, 'o', {grow})))"
        ),
    )
    g = f"{kind}_g" if f"{kind}_g" in df.columns else m
    spans = f"transform(arrays_zip({kind}_o, {n}, {m}, {g}), z -> named_struct('start', z.{kind}_o + z.{n} - length(z.{m}), 'kind', {KINDS.index(kind)}, 'end', z.{kind}_o + z.{n}, 'match', z.{m}, 'group', z.{g}))"
    spans = spans if g != m else spans.replace(f", {g}), z", "), z")
    return df.withColumn(f"{kind}_s", F.coalesce(F.expr(spans), F.expr("cast(array() as array<struct<start:int,kind:int,end:int,match:string,group:string>>)"))).drop(
        m, p, n, g, f"{kind}_c", f"{kind}_b", f"{kind}_o"
    )


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, text, and assign_s, access_s, hex_s."""
    df = docs.select(*keep, whole_text().alias("text"))
    df = _lengths(df, "assign", ASSIGN, rf"(?i:{KEYWORD})", 2)
    df = _lengths(df, "access", ACCESS)
    df = _lengths(df, "hex", HEX)
    for kind in KINDS[:3]:
        df = _placed(df, kind)
    return df.withColumn("assign_s", F.expr(f"filter(assign_s, s -> length(s.group) >= {ASSIGN_LEAST})"))


def _symbol(char: str) -> str:
    """The index of a character, 0 for one outside the alphabet."""
    return f"instr('{ALPHABET}', {char})"


def transition_counts(samples: DataFrame) -> DataFrame:
    """(random boolean, s string) to (random, a, b, n): how often symbol b follows symbol a."""
    chars = samples.filter(F.length("s") > 1).select("random", F.split("s", "").alias("c"))
    pair = F.explode(F.expr("arrays_zip(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1))"))
    pairs = chars.select("random", pair.alias("p")).select("random", F.col("p")["0"].alias("x"), F.col("p")["1"].alias("y"))
    pairs = pairs.groupBy("random", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.select("random", F.expr(_symbol("x")).alias("a"), F.expr(_symbol("y")).alias("b"), "n")
    return pairs.groupBy("random", "a", "b").agg(F.sum("n").alias("n"))


def log_ratios(counts: list[tuple[bool, int, int, int]]) -> list[float]:
    """log P(b|a, random) - log P(b|a, ordinary) at a * SYMBOLS + b.

    P(b|a) is smoothed with the symbol's own probability P(b), this one by one added to every count: a symbol that
    ordinary strings don't have is unlikely after any other.
    """

    def model(random: bool) -> list[float]:
        n = [[0.0] * SYMBOLS for _ in range(SYMBOLS)]
        for kind, a, b, count in counts:
            if kind == random:
                n[a][b] += count
        total = sum(map(sum, n)) + SYMBOLS
        p = [(sum(row[b] for row in n) + 1) / total for b in range(SYMBOLS)]
        return [(n[a][b] + SYMBOLS * p[b]) / (sum(n[a]) + SYMBOLS) for a in range(SYMBOLS) for b in range(SYMBOLS)]

    return [math.log(r) - math.log(o) for r, o in zip(model(True), model(False), strict=True)]


def train(docs: DataFrame, ident: str = "doc_id", train_docs: int = TRAIN_DOCS) -> list[float]:
    """The log ratios; the driver gets at most 2 * SYMBOLS ** 2 counts."""
    total = docs.count()
    share = min(1.0, train_docs / max(1, total))
    sample = docs.filter(F.pmod(F.xxhash64(ident), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else docs
    spans = base_spans(sample, [])
    random = spans.select(F.explode(F.expr("concat(transform(assign_s, s -> s.group), transform(access_s, s -> s.match), transform(hex_s, s -> s.match))")).alias("s"))
    # ordinary words are those outside all matches
    rest = F.regexp_replace(F.regexp_replace(whole_text(), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), 0)).alias("s"))
    samples = random.select(F.lit(True).alias("random"), "s").unionByName(words.select(F.lit(False).alias("random"), "s"))
    return log_ratios([(r.random, r.a, r.b, r.n) for r in transition_counts(samples).collect()])


def sum_ratio(token: str, ratios: str) -> str:
    """SQL for the sum of a token's log-likelihood ratios over its transitions."""
    step = f"named_struct('last', {_symbol('c')}, 'sum', a.sum + if(a.last < 0, 0D, {ratios}[a.last * {SYMBOLS} + {_symbol('c')}]))"
    return f"aggregate(split({token}, ''), named_struct('last', -1, 'sum', 0D), (a, c) -> {step}, a -> a.sum)"


def _joined(spans: Column) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.expr(names)[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], ident: str = "doc_id", min_ratio: float = MIN_RATIO) -> DataFrame:
    """ident, base and markov: arrays of (start, kind, end, match, group), sorted by start and kind."""
    df = _placed(_lengths(base_spans(docs, [ident]), "markov", TOKEN), "markov")
    model = "split('" + ",".join(f"{x:.6f}" for x in ratios) + "', ',')"
    df = df.withColumn("base", F.array_sort(F.concat("assign_s", "access_s", "hex_s")))
    free = "not exists(base, b -> b.start < s.end and s.start < b.end)"
    mixed = "s.match rlike '[A-Za-z]' and s.match rlike '[0-9a-z]'"
    df = df.withColumn("tokens", F.expr(f"filter(markov_s, s -> {mixed} and {free})"))
    summed = sum_ratio("s.match", f"cast({model} as array<double>)")
    df = df.withColumn("sums", F.expr(f"transform(tokens, s -> named_struct('s', s, 'sum', {summed}))"))
    enough = f"x.sum > if(x.s.match rlike '[0-9]', {MIN_SUM}D, {MIN_SUM_LETTERS}D) and x.sum > {min_ratio}D * (length(x.s.match) - 1)"
    df = df.withColumn("markov", F.expr(f"transform(filter(sums, x -> {enough}), x -> x.s)"))
    return df.select(ident, "base", "markov")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select(
        "doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "markov"))).alias("spans")
    )
