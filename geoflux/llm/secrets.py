"""Secret scans, in DataFrame functions only.

Base kinds are fixed patterns. A battery of randomness tests finds further
secrets: every run of token characters is read in the encoding its characters
imply, and tested for a uniform alphabet (chi-squared), for runs about the
middle of the alphabet, and for serial correlation. Fisher's method combines
the three. Random strings have uniform p-values and ordinary words have small
ones, so the share of false discoveries above a cut can be estimated from the
p-values of the whole corpus; the cut is set for each encoding and band of
lengths, as short strings tell less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

# Fixed patterns of the base kinds, in the order of their listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of the class is taken whole, so this is AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

# Alphabets of the encodings, tried in this order.
ENCODINGS = (
    ("decimal", "0123456789", r"^[0-9]+$"),
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$"),
    ("hex_upper", "0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^[0-9A-Za-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+=*$"),
    ("base64_url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+=*$"),
)
#: Lower ends of the bands of lengths.
BANDS = (20, 28, 40, 64, 128)
BINS = 50


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<pos, gap, s>>: all leftmost non-overlapping matches, each with the length of the text since the one before."""
    # split() and regexp_extract_all() see the same matches, so the k-th gap stands before the k-th match.
    found = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["s"].isNotNull()))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    # Fixed coefficients of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(spans: DataFrame) -> DataFrame:
    """``spans(s, ...)`` plus encoding, p (Fisher's combination of the three tests); spans that fit no encoding are left out.

    Trailing '=' is padding and not tested. Fewer than 20 tested characters: left out.
    """
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for enc, letters, pattern in reversed(ENCODINGS):
        fits = F.col("s").rlike(pattern)
        name, alphabet = F.when(fits, enc).otherwise(name), F.when(fits, letters).otherwise(alphabet)
    d = spans.withColumns({"encoding": name, "alphabet": alphabet, "body": F.rtrim(F.col("s"), F.lit("="))}).where("encoding is not null")
    d = d.withColumns({"x": F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> instr(alphabet, c) - 1)"), "k": F.length("alphabet")})
    d = d.withColumn("n", F.size("x")).where("n >= 20")
    total = lambda e: F.expr(f"aggregate({e}, 0D, (a, b) -> a + b)")
    d = d.withColumn("chi", total("transform(sequence(0, k - 1), j -> pow(size(filter(x, v -> v = j)), 2))") * F.col("k") / F.col("n") - F.col("n"))
    # The moments of the statistic for small counts: mean k-1, variance 2(k-1)(n-1)/n.
    z_chi = (F.col("chi") - (F.col("k") - 1)) / F.sqrt(2.0 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))
    d = d.withColumn("hi", F.expr("transform(x, v -> if(2 * v >= k, 1, 0))"))
    d = d.withColumn("ones", total("hi").cast("double")).withColumn("zeros", F.col("n") - F.col("ones"))
    d = d.withColumn("runs", 1 + total("zip_with(slice(hi, 2, n - 1), slice(hi, 1, n - 1), (a, b) -> abs(a - b))"))
    two = 2.0 * F.col("ones") * F.col("zeros")
    mean_runs, var_runs = two / F.col("n") + 1, two * (two - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1.0))
    d = d.withColumn("mean", total("x") / F.col("n"))
    num = total("zip_with(slice(x, 2, n - 1), slice(x, 1, n - 1), (a, b) -> (a - mean) * (b - mean))")
    den = total("transform(x, v -> pow(v - mean, 2))")
    d = d.withColumns({"num": num, "den": den, "z_chi": z_chi})
    z_runs = F.when(var_runs > 0, F.abs(F.col("runs") - mean_runs) / F.sqrt(var_runs)).otherwise(40.0)
    z_corr = F.when(F.col("den") > 0, F.abs(F.col("num") / F.col("den") + 1 / F.col("n")) * F.sqrt("n")).otherwise(40.0)
    safe = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30))
    p1, p2, p3 = safe(_normal_tail(F.col("z_chi"))), safe(2 * _normal_tail(z_runs)), safe(2 * _normal_tail(z_corr))
    half = -(F.log(p1) + F.log(p2) + F.log(p3))  # half of Fisher's statistic
    return d.withColumn("half", half).withColumn("p", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))


def cuts(p_values: DataFrame, rate: float) -> DataFrame:
    """(encoding, band, cut): the smallest p above which at most ``rate`` of the spans are estimated not to be random.

    The spans with p above one half, doubled, estimate the random ones; the
    excess of a bin over its share of them is false. A band without such a cut
    has none. The table has encodings x bands rows at most.
    """
    bins = p_values.groupBy("encoding", "band", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    group = bins.groupBy("encoding", "band").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # BINS entries at most
    above = lambda b: f"aggregate(sequence({b}, {BINS - 1}), 0L, (a, j) -> a + coalesce(m[cast(j as bigint)], 0L))"
    random_ones = f"(2.0D * {above(BINS // 2)})"
    good = F.expr(f"filter(sequence(1, {BINS // 2}), b -> {above('b')} > 0 and 1 - {random_ones} * ({BINS} - b) / {BINS} / {above('b')} <= {rate})")
    return group.select("encoding", "band", (F.array_min(good) / BINS).alias("cut")).where("cut is not null")


def _parts(runs: DataFrame) -> DataFrame:
    """The runs that one encoding can hold, and of those that mix the signs of several their parts of letters and digits."""
    mixed = F.col("s").rlike("[+/]") & F.col("s").rlike("[_-]")
    parts = runs.where(mixed).withColumn("m", F.filter(F.arrays_zip(F.transform(F.split("s", "[A-Za-z0-9]{20,}", -1), F.char_length).alias("gap"), F.regexp_extract_all("s", F.lit("[A-Za-z0-9]{20,}"), F.lit(0)).alias("t")), lambda x: x["t"].isNotNull()))
    # Where a part begins: all gaps up to it and all parts before it.
    at = F.expr("transform(m, (x, i) -> named_struct('from', start + aggregate(slice(m, 1, i + 1), 0, (n, y) -> n + y.gap) + aggregate(slice(m, 1, i), 0, (n, y) -> n + length(y.t)), 't', x.t))")
    parts = parts.select("row", "kind_no", F.explode(at).alias("p")).select("row", "kind_no", F.col("p.from").cast("int").alias("start"), (F.col("p.from") + F.length("p.t")).cast("int").alias("end"), F.col("p.t").alias("s"))
    return runs.where(~mixed).unionByName(parts)


def secret_scan(docs: DataFrame, false_rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, spans array<struct<start, kind_no, end>>), by start and then kind.

    ``kind_no`` is the place in ``KINDS``. Base kinds are assign, access and hex; kind random is what the battery
    adds at an estimated share ``false_rate`` of false ones. Offsets are code
    points, ends exclusive. Null and empty texts have no spans; ids may be
    null or repeated; other columns are not read. Whole texts are scanned.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.expr("cast(null as array<struct<gap:int,s:string>>)")
    found = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.coalesce(_matches(text, p), none).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)])
    # Only places and matched strings are kept: the text is read once and moves nowhere.
    found = scratch.save(found.withColumn("row", F.monotonically_increasing_id()))
    parts = None
    for no, kind in enumerate(KINDS):
        one = found.where(F.col(kind).isNotNull()).select("row", F.posexplode(kind).alias("pos", "m")).select("row", "pos", F.lit(no).alias("kind_no"), "m.gap", "m.s")
        parts = one if parts is None else parts.union(one)
    upto = Window.partitionBy("row", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = parts.withColumn("end", F.sum(F.col("gap") + F.char_length("s")).over(upto).cast("int")).withColumn("start", F.col("end") - F.char_length("s"))
    spans = scratch.save(spans.select("row", "kind_no", "start", "end", "s"))
    base = spans.where("kind_no < 3").where((F.col("kind_no") > 0) | (F.length(F.regexp_extract("s", ASSIGN, 2)) >= 6)).select("row", "kind_no", "start", "end")
    band = F.expr(f"element_at(filter(array({', '.join(map(str, BANDS))}), b -> b <= n), -1)")
    tested = scratch.save(battery(_parts(spans.where("kind_no = 3"))).select("row", "kind_no", "start", "end", "encoding", band.alias("band"), "p"))
    # At most one row for each encoding and band.
    added = tested.join(F.broadcast(cuts(tested, false_rate)), ["encoding", "band"]).where("p >= cut").select("row", "kind_no", "start", "end")
    per_row = base.union(added).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("spans"))
    return found.select("id", "row").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int>>)")).alias("spans")
    )


def op4(docs: DataFrame) -> DataFrame:
    count = lambda no: F.expr(f"cast(size(filter(spans, s -> s.kind_no = {no})) as bigint)")
    names = ", ".join(f"'{k}'" for k in KINDS)
    written = lambda which: f"array_join(transform({which}, s -> concat(element_at(array({names}), s.kind_no + 1), ':', s.start, ':', s.end)), ',')"
    return secret_scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(written("filter(spans, s -> s.kind_no < 3)")).cast("binary"), 256).alias("base_sha256"),
        F.expr(written("spans")).alias("spans"),
    )
