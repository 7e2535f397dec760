"""Secrets in texts: fixed formats, and tokens that look random.

Built from DataFrame functions only.  Three kinds have a fixed form (assign,
access, hex).  The kind ``random`` is found by a test battery on other long
tokens.  Each token's encoding is inferred from its letters.  Three statistics
are compared with what words, numbers and identifiers of that encoding show:

* chi-squared distance of the letters from a uniform alphabet,
* runs: changes between digits, capitals and small letters, separators aside; in
  a token of one of these classes, changes between vowels and consonants, which
  words alternate, or between the lower and the upper half of the digits,
* serial correlation of neighbouring letters' places in the alphabet; in a token
  of one class of letters, where words show none, the share of rare letters.

Each gives a p-value against structured text, small for random tokens.  They are
combined by Fisher's method and weighted by length, and the Benjamini-Hochberg
procedure over all tokens of the corpus bounds the share of false discoveries.
Its ranks come from a histogram of fixed size, so nothing is sorted or
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.functions.skew import one_row

# The formats of the three fixed kinds, and the least length of an assigned value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
FALSE_DISCOVERIES = 0.01
CELLS = 64  # of the p-value histogram, per unit of -ln p
MOST_CELL = 45 * CELLS
DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [  # name, form, alphabet
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+=*$", SMALL.upper() + "234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + SMALL),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + SMALL.upper() + SMALL),
    ("base64", "", SMALL.upper() + SMALL + DIGITS + "+/-_"),
]
TEXT_REPEAT = 0.065  # chance that two letters of a text agree
TEXT_CHANGES = 0.15  # changes of letter class per letter in words and identifiers
TEXT_SERIAL = 0.5
VOWELS, RARE = "aeiouyAEIOUY", "bjkpqvwxyzBJKPQVWXYZ"
WORD_CHANGES = 0.6  # changes between vowels and consonants per letter of a word
NUMBER_CHANGES = 0.25  # changes between the halves of the digits in dates, counters and padded numbers
TEXT_RARE = 0.12  # share of the rare letters in words
PLAIN = 0.5  # a token that one test finds this likely to be structured is not random, whatever the others say


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Running sums of an array, block by block, so that long arrays cost little more than their length."""
    zero = F.array().cast("array<int>")

    def running(v: Column) -> Column:
        return F.aggregate(v, zero, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block) - 1, F.lit(0)).cast("int")), lambda b: F.slice(values, b * block + 1, block))
    totals = F.transform(blocks, lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x))
    ends = running(totals)
    shifted = F.zip_with(blocks, F.zip_with(ends, totals, lambda e, t: e - t), lambda v, before: F.transform(running(v), lambda x: x + before))
    return F.flatten(shifted)


def spans(text: Column, pattern: str, value_group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, body), in code points.

    The gaps between matches come from splitting at the same pattern.  With
    ``value_group``, matches whose group is under ``LEAST_VALUE`` characters are
    dropped afterwards.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    ends = prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m)))
    out = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("body")))
    if value_group is not None:
        long_enough = F.transform(F.regexp_extract_all(text, p, F.lit(value_group)), lambda v: F.length(v) >= LEAST_VALUE)
        pairs = F.zip_with(out, long_enough, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok")))
        out = F.transform(F.filter(pairs, lambda x: x["ok"]), lambda x: x["s"])
    none = F.array().cast("array<struct<start: int, end: int, body: string>>")
    return F.when(text.rlike(pattern), out).otherwise(none)


def normal_below(z: Column) -> Column:
    """Standard normal distribution function, by the logistic form with a cubic term, and by the tail bound far out."""
    x = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    near = 1 / (1 + F.exp(-(1.5976 * x + 0.07056 * x * x * x)))
    far = F.exp(-x * x / 2) / (F.abs(x) * 2.5066282746310002)
    return F.when(x < -3, far).when(x > 3, 1 - far).otherwise(near)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to ``tokens`` (body) its encoding, letter count and the combined p-value against structured text."""
    plain = F.regexp_replace("body", "=+$", "")
    encoding, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, form, letters in reversed(ENCODINGS[:-1]):
        fits = F.col("body").rlike(form)
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(letters)).otherwise(alphabet)
    folded = F.when(F.col("encoding").isin("hex", "base36"), F.lower("plain")).otherwise(F.col("plain"))
    t = tokens.withColumn("plain", plain).withColumn("encoding", encoding).withColumn("alphabet", alphabet)
    t = t.withColumn("letters", F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0))).withColumn("n", F.size("letters").cast("double"))
    t = t.withColumn("places", F.transform("letters", lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    sort = lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[a-z]"), 2).otherwise(3)
    t = t.withColumn("sorts", F.transform("letters", sort))
    k = F.length("alphabet").cast("double")
    squares = F.aggregate(F.array_distinct("letters"), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter("letters", lambda x: x == c)).cast("double"), 2.0))
    shift = F.col("n") * F.greatest(F.lit(0.5), k * TEXT_REPEAT - 1)
    uniform = normal_below((squares * k / F.col("n") - F.col("n") - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift)))
    n1 = F.col("n") - 1
    next_of = lambda a: F.slice(a, 2, F.size(a))
    changes = F.aggregate(F.zip_with(F.slice("sorts", 1, F.size("sorts") - 1), next_of("sorts"), lambda a, b: ((a != b) & (a < 3) & (b < 3)).cast("double")), F.lit(0.0), lambda a, x: a + x)
    runs = normal_below(-(changes - 0.5 - n1 * TEXT_CHANGES) / F.sqrt(n1 * TEXT_CHANGES * (1 - TEXT_CHANGES)))
    # Tokens of one class, separators aside: m letters, neighbours among them.
    bare = F.regexp_replace("plain", "[^0-9A-Za-z]", "")
    m = F.greatest(F.length(bare).cast("double"), F.lit(2.0))
    words, numbers = bare.rlike("^([a-z]+|[A-Z]+)$"), bare.rlike("^[0-9]+$")
    turns = lambda letters: (  # noqa: E731  changes between these letters and others
        F.length(F.regexp_replace(bare, f"(?<=[{letters}])(?=[^{letters}])|(?<=[^{letters}])(?=[{letters}])", " ")) - F.length(bare)
    ).cast("double")
    spelt = normal_below((turns(VOWELS) + 0.5 - (m - 1) * WORD_CHANGES) / F.sqrt((m - 1) * WORD_CHANGES * (1 - WORD_CHANGES)))
    counted = normal_below(-(turns("0-4") - 0.5 - (m - 1) * NUMBER_CHANGES) / F.sqrt((m - 1) * NUMBER_CHANGES * (1 - NUMBER_CHANGES)))
    runs = F.when(words, spelt).when(numbers, counted).otherwise(runs)
    rare = normal_below(-(F.length(F.regexp_replace(bare, f"[^{RARE}]", "")) - 0.5 - m * TEXT_RARE) / F.sqrt(m * TEXT_RARE * (1 - TEXT_RARE)))
    mean = F.aggregate("places", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    t = t.withColumn("off", F.transform(F.arrays_zip(F.col("places"), F.array_repeat(mean, F.size("places")).alias("mean")), lambda x: x["places"] - x["mean"]))
    spread = F.aggregate("off", F.lit(0.0), lambda a, x: a + x * x)
    along = F.aggregate(F.zip_with(F.slice("off", 1, F.size("off") - 1), next_of("off"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    r = F.when(spread > 0, F.least(F.abs(along / spread), F.lit(0.999))).otherwise(F.lit(0.999))
    serial = normal_below((F.atanh(r) - F.atanh(F.lit(TEXT_SERIAL))) * F.sqrt(F.col("n") - 3))
    serial = F.when(words, rare).otherwise(serial)
    least = F.lit(1e-12)
    evidence = -(F.log(F.greatest(uniform, least)) + F.log(F.greatest(runs, least)) + F.log(F.greatest(serial, least)))
    t = t.withColumn("evidence", F.when(F.greatest(uniform, runs, serial) > PLAIN, F.lit(0.0)).otherwise(evidence))
    e = F.col("evidence")
    return t.withColumn("p", F.exp(-e) * (1 + e + e * e / 2)).drop("plain", "alphabet", "letters", "places", "sorts", "off", "evidence")


def discoveries(tokens: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The tokens (n, p) that weighted Benjamini-Hochberg keeps at this rate of false discoveries.

    A token's weight is its length, up to 64 letters, over the mean of that.
    P-values are rounded up to a grid of ``CELLS`` per unit of -ln p, on which
    the procedure is exact.
    """
    t = tokens.withColumn("weight", F.least(F.col("n"), F.lit(64.0)))
    t = one_row(t, t.agg(F.avg("weight").alias("mean_weight")))
    own = F.least(F.greatest(F.floor(-F.log(F.greatest(F.col("p") * F.col("mean_weight") / F.col("weight"), F.lit(1e-30))) * CELLS), F.lit(0)), F.lit(MOST_CELL))
    t = t.withColumn("cell", own.cast("int"))
    cells = t.groupBy("cell").agg(F.count(F.lit(1)).alias("n_cell"))  # MOST_CELL rows at most
    everything = Window.partitionBy(F.lit(0))
    ranked = cells.withColumn("rank", F.sum("n_cell").over(everything.orderBy(F.desc("cell")))).withColumn("m", F.sum("n_cell").over(everything))
    cutoff = ranked.where(F.exp(-F.col("cell") / CELLS) <= rate * F.col("rank") / F.col("m")).agg(F.min("cell").alias("cutoff"))
    return one_row(t, cutoff).where("cell >= cutoff").drop("weight", "mean_weight", "cell", "cutoff")


def scan(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, assign, access, hex, random.

    ``row`` hashes doc_id and text and tells rows of one doc_id apart; the other
    columns are arrays of (start, end) in code points.  A null text counts as
    empty, a null doc_id is kept, repeated rows get equal results, an empty
    table gives none.  Random tokens that overlap a span of a fixed kind are no
    candidates.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), body).alias("row"))
    bare = "array<struct<start: int, end: int>>"
    drop_body = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(bare)
    found = t.select(
        "doc_id", "row", drop_body(spans(F.col("text"), ASSIGN, 2)).alias("assign"), drop_body(spans(F.col("text"), ACCESS)).alias("access"),
        drop_body(spans(F.col("text"), HEX)).alias("hex"), spans(F.col("text"), TOKEN).alias("tokens"),
    )
    found = materialise(found)
    fixed = F.concat("assign", "access", "hex")
    free = F.filter("tokens", lambda c: ~F.exists(fixed, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])))
    tokens = found.select("doc_id", "row", F.explode(free).alias("t")).select("doc_id", "row", "t.start", "t.end", "t.body")
    kept = discoveries(battery(tokens), rate)
    random = kept.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("random"))
    out = found.drop("tokens").join(random, "row", "left")
    return out.withColumn("random", F.coalesce("random", F.array().cast(bare)))


def labelled(kinds: tuple[str, ...]) -> Column:
    """All spans of ``scan`` as kind:start:end, by start, then kind as listed; comma-joined."""
    def part(k: int, kind: str) -> Column:
        said = lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), said(s).alias("said")))

    parts = [part(k, kind) for k, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["said"]), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and n_chars, if there, counted again; clean rows as they were.

    Overlapping spans are replaced together.  Columns and rows are kept.
    """
    spans_of_row = scan(docs, rate=rate).select("row", F.array_sort(F.concat("assign", "access", "hex", "random")).alias("_spans")).where(F.size("_spans") > 0)
    spans_of_row = spans_of_row.groupBy("row").agg(F.first("_spans").alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("gaps"))

    def gap(a: Column, s: Column) -> Column:
        grown = F.when(s["start"] >= a["at"], F.concat(a["gaps"], F.array(F.struct(a["at"].alias("start"), s["start"].alias("end"))))).otherwise(a["gaps"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), grown.alias("gaps"))

    gaps = F.aggregate("_spans", start, gap, lambda a: F.concat(a["gaps"], F.array(F.struct(a["at"].alias("start"), F.size("_chars").alias("end")))))
    pieces = F.transform("_gaps", lambda g: F.array_join(F.slice("_chars", g["start"] + 1, g["end"] - g["start"]), ""))
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    joined = docs.withColumn("_row", row).join(spans_of_row.withColumnRenamed("row", "_row"), "_row", "left")
    chars = F.when(F.col("_spans").isNotNull(), F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))
    out = joined.withColumn("_chars", chars).withColumn("_gaps", gaps).withColumn("_clean", F.col("_spans").isNull())
    out = out.withColumn("text", F.when(F.col("_clean"), F.col("text")).otherwise(F.array_join(pieces, mark)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_clean"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
