"""Secret scanning with DataFrame expressions only.

Three fixed patterns give the base spans. Java's split and regexp_extract_all walk a text alike, so
the pieces between matches and the matches themselves, added up in turn, give code-point offsets
without any procedural code. Further candidate strings (long runs of token characters that mix
letters and digits) are judged by Shannon entropy in a sliding window per character class: a fold
over the characters keeps one count per distinct character and the running sum of c*log2(c), so a
step costs two updates. Candidates that an allow list matches, or that a base span covers, add
nothing.

Defined cases: null and empty texts have no spans; overlapping spans of different kinds all stay; a
text of any length is scanned whole; other columns never enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the contract: kind, pattern, group whose length counts, its least length
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Same matches as the base pattern and length test together, but short runs are never extracted.
DIRECT = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}"}
#: class, candidate pattern, window, least bits a character somewhere in the string
CLASSES = (
    ("entropy_hex", r"(?<![A-Za-z0-9+/_=-])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_=-])", 16, 3.0),
    ("entropy_mixed", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])(?![0-9A-Fa-f]++(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+", 20, 3.5),
)
#: strings that look random but are known not to be secrets
ALLOWED = (
    r"(?i)example",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)^(0123456789abcdef)+$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9A-Za-z:_-]*$",
    r"^/?([A-Za-z]+/)+[A-Za-z0-9_-]+$",
)
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in CLASSES)


def _located(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """array<struct<s, kind, e, body>> of matches whose ``group`` has at least ``least`` characters."""
    p = F.lit(pattern)
    gaps, found, bodies = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    rows = F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), found.alias("m"), bodies.alias("b"))
    none = F.array().cast("array<struct<s:int,kind:int,e:int,body:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.coalesce(F.char_length(x["m"]), F.lit(0))
        hit = F.array(F.struct(s.alias("s"), F.lit(kind).alias("kind"), e.alias("e"), x["b"].alias("body")))
        good = F.coalesce(F.char_length(x["b"]) >= least, F.lit(False))
        return F.struct(e.alias("at"), F.when(good, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp_like(text, p), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(none)


def _term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def peak_entropy(body: Column, window: int) -> Column:
    """Greatest Shannon entropy (bits a character) of any ``window`` consecutive characters."""
    size = F.char_length(body)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(body, i, F.lit(1)))
    width = F.least(size, F.lit(window))
    letters = F.array_distinct(chars)
    codes = F.transform(chars, lambda c: F.array_position(letters, c).cast("int"))
    start = F.struct(
        F.lit(0).alias("i"), F.transform(letters, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least")
    )

    def step(acc: Column, code: Column) -> Column:
        i = acc["i"]
        gone = F.when(i >= width, F.element_at(codes, F.greatest(i - width + 1, F.lit(1)))).otherwise(F.lit(0))
        before = F.element_at(acc["counts"], code) - (gone == code).cast("int")
        leaving = F.when(gone > 0, F.element_at(acc["counts"], F.greatest(gone, F.lit(1)))).otherwise(F.lit(0))
        total = acc["sum"] + _term(leaving - 1) - _term(leaving) + _term(before + 1) - _term(before)
        counts = F.transform(acc["counts"], lambda n, k: n + (k + 1 == code).cast("int") - (k + 1 == gone).cast("int"))
        least = F.when(i + 1 >= width, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct((i + 1).alias("i"), counts.alias("counts"), total.alias("sum"), least.alias("least"))

    w = width.cast("double")
    return F.aggregate(codes, start, step, lambda acc: F.log2(w) - acc["least"] / w)


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, base and added: arrays of struct<s, kind, e, body> (kind: place in ``KINDS``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    t = F.col("_text")
    base = [_located(t, DIRECT.get(kind, pattern), i, group, least) for i, (kind, pattern, group, least) in enumerate(BASE)]
    found = [_located(t, pattern, len(BASE) + i, 0, window) for i, (_, pattern, window, _) in enumerate(CLASSES)]
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*found).alias("found"))
    suspicious = lambda x: ~F.exists(F.array(*[x["body"].rlike(p) for p in ALLOWED]), lambda hit: hit) & F.coalesce(
        *[F.when(x["kind"] == len(BASE) + i, peak_entropy(x["body"], window) >= bits) for i, (_, _, window, bits) in enumerate(CLASSES)]
    )
    fresh = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    return rows.select("doc_id", "base", F.when(F.size("found") > 0, F.filter(fresh, suspicious)).otherwise(F.col("found")).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
