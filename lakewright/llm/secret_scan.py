"""Secret scans: fixed patterns, and a randomness test battery for other tokens.  DataFrame operations only.

Tokens of 20 characters or more of [A-Za-z0-9+/_=-] are tested against an inferred encoding
(decimal, lower or upper hexadecimal, base32, one letter case, base62/64).  Three statistics tell a random token from one made of words,
each standardised under a fixed model of word tokens at the token's own length and encoding, so that no other token of the input is needed:

* uniformity: equal pairs of characters (chi-squared is linear in their number), which words have more of; a gamma variable;
* runs: changes between capitals, small letters and digits, signs left out, which words have fewer of;
* serial dependence: changes between vowels and consonants from one letter to the next, which words have more of.

Rates of words differ from token to token: both rates have a spread of their own beside the binomial one.  The combined z is the sum of the
statistics that the encoding has, over the root of their number and WIDEN; p is its upper normal tail.  Tokens that a runs test about the
alphabet's middle or the lag-1 serial correlation of the character codes finds too regular to be random (sequences, repeats) have p = 1.
Benjamini-Hochberg within the length class, apart for tokens of one letter case, keeps the false discovery rate at RATE.  A token is one
test however often it occurs.  All counts are over all distinct tokens of the input, in a histogram of fixed size (length classes x p bins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import join_hot, materialise

#: The base patterns in their order, with the least length of the whole match (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
RATE = 0.05
#: Bins of -log2(p).
BINS, BIN_WIDTH = 512, 0.125
#: The model of word tokens.  The chance that two characters are equal (a multiple of 1 / k in small alphabets; in the large one a number), and its spread beyond a Poisson
#: variable's; the rates of changes of kind and between vowels and consonants, with the variances of these rates between tokens; the widening of the combined z.
REPEAT, REPEAT_MIXED, EXTRA = 1.72, 0.048, 1.5
KINDS_RATE, KINDS_SPREAD, VOWELS_RATE, VOWELS_SPREAD, WIDEN = 0.18, 0.01, 0.70, 0.015, 1.1
#: The largest z of a random token in the tests of regularity; the bounds of one statistic; pairs of letters that the vowels need.
LIMIT_Z, CLIP_Z, LETTERS = 3.0, 4.0, 4
_CUT = "\x01"
_STEP = 128


def _pieces(text: Column, pattern: str) -> Column:
    """Non-match, match, non-match, ...: the text cut around the leftmost non-overlapping matches."""
    return F.split(F.regexp_replace(F.translate(text, _CUT, "\x02"), F.lit(pattern), F.lit(f"{_CUT}$0{_CUT}")), _CUT)


def _places(pieces: str, kind: int, keep: str) -> str:
    """SQL for array<struct<start, kind, end, value>> of the matches among pieces that pass keep (over x).

    Running offsets are summed in blocks of _STEP pieces, then over blocks, so long lists stay cheap.
    """
    empty = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"
    inner = (
        f"aggregate(slice({pieces}, b * {_STEP} + 1, {_STEP}), named_struct('at', 0, 'odd', false, 'out', {empty}), (a, x) -> named_struct("
        f"'at', a.at + length(x), 'odd', not a.odd, 'out', if(a.odd and {keep}, concat(a.out, array(named_struct('start', a.at, 'kind', {kind}, 'end', a.at + length(x), 'value', x))), a.out)))"
    )
    return f"transform(sequence(0, cast((size({pieces}) - 1) div {_STEP} as int)), b -> {inner})"


def _joined(blocks: str) -> str:
    """SQL that adds each block's offset to its places."""
    offsets = f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    return f"flatten(zip_with({blocks}, {offsets}, (x, o) -> transform(x.out, s -> named_struct('start', s.start + o, 'kind', s.kind, 'end', s.end + o, 'value', s.value))))"


def _battery(token: str) -> dict[str, str]:
    """SQL of the tests of column `token`, step by step (column -> expression)."""
    return {
        "n": f"length({token})",
        "alphabet": f"""case when {token} rlike '^[0-9]+$' then '0123456789' when {token} rlike '^[0-9a-f]+$' then '0123456789abcdef' when {token} rlike '^[0-9A-F]+$' then '0123456789ABCDEF'
            when {token} rlike '^[A-Z2-7]+=*$' and {token} rlike '[2-7]' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' when {token} rlike '^[a-z]+$' then 'abcdefghijklmnopqrstuvwxyz' when {token} rlike '^[A-Z]+$' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'
            else 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-' end""",
        "k": "length(alphabet)",
        "v": f"transform(split({token}, ''), c -> instr(alphabet, c))",
        "squares": f"aggregate(array_distinct(split({token}, '')), 0D, (a, c) -> a + pow(n - length(replace({token}, c, '')), 2))",
        "equal": "(squares - n) / 2",
        "expected": f"n * (n - 1D) / 2 * if(k > 32, {REPEAT_MIXED}D, {REPEAT}D / k)",
        "shape": f"1 / (1 / expected + {EXTRA}D / n)",
        "chi_z": "(1 - 1 / (9 * shape) - pow(equal / expected, 1 / 3D)) * 3 * sqrt(shape)",
        "signless": f"regexp_replace({token}, '[+/_=-]', '')",
        "pairs": "length(signless) - 1",
        "kinds": "regexp_count(signless, '[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])')",
        "kinds_z": f"if(pairs > 0 and signless rlike '[0-9]' and signless rlike '[A-Za-z]' or k > 32, (kinds / greatest(pairs, 1) - {KINDS_RATE}D) / sqrt({KINDS_RATE * (1 - KINDS_RATE)}D / greatest(pairs, 1) + {KINDS_SPREAD}D), null)",
        "letters": f"regexp_count({token}, '(?i)[a-z](?=[a-z])')",
        "vowels": f"regexp_count({token}, '(?i)[aeiouy](?=[b-df-hj-np-tv-xz])|[b-df-hj-np-tv-xz](?=[aeiouy])')",
        "vowels_z": f"if(k in (10, 16), null, if(letters < {LETTERS}, 0D, ({VOWELS_RATE}D - vowels / greatest(letters, 1)) / sqrt({VOWELS_RATE * (1 - VOWELS_RATE)}D / greatest(letters, 1) + {VOWELS_SPREAD}D)))",
        "z": f"""aggregate(filter(array(chi_z, kinds_z, vowels_z), x -> x is not null), 0D, (a, x) -> a + greatest(-{CLIP_Z}D, least({CLIP_Z}D, x)))
            / sqrt(1D + int(kinds_z is not null) + int(vowels_z is not null)) / {WIDEN}D""",
        "ups": "aggregate(v, 0, (a, x) -> a + if(2 * x > k, 1, 0))",
        "runs": "1 + aggregate(sequence(2, n), 0, (a, i) -> a + if((2 * v[i - 1] > k) <> (2 * v[i - 2] > k), 1, 0))",
        "runs_mean": "1 + 2D * ups * (n - ups) / n",
        "runs_z": "if(runs_mean > 2, abs(runs - runs_mean) / sqrt((runs_mean - 1) * (runs_mean - 2) / (n - 1) + 1e-9), 8D)",
        "mean": "aggregate(v, 0D, (a, x) -> a + x) / n",
        "spread": "aggregate(v, 0D, (a, x) -> a + pow(x - mean, 2))",
        "serial_z": "if(spread > 0, abs(aggregate(sequence(2, n), 0D, (a, i) -> a + (v[i - 1] - mean) * (v[i - 2] - mean))) / spread * sqrt(n), 8D)",
        # an upper bound of the normal tail beyond z, in bits: exact to a few per cent
        "bits": f"if(z > 0 and runs_z <= {LIMIT_Z}D and serial_z <= {LIMIT_Z}D, (z * z / 2 + ln(z + sqrt(z * z + 8 / pi())) + ln(pi() / 2) / 2) / ln(2D), 0D)",
    }


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, spans) for every row of docs(doc_id, text): spans array<struct<start, kind, end, value>> by start, then kind.

    Offsets are code points, end exclusive; kind numbers KINDS.  Null texts are empty and have no spans.
    Every row is judged alone, so repeated rows and null ids need no care; other columns are not read.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = text.select("doc_id", *(_pieces(F.col("text"), p).alias(c) for c, p in (("p0", ASSIGN), ("p1", ACCESS), ("p2", HEX), ("p3", TOKEN))))
    keep0 = "length(regexp_extract(x, '" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + "', 2)) >= 6"
    blocks = cut.select("doc_id", *(F.expr(f"if(size(p{k}) < 2, null, {_places(f'p{k}', k, keep)})").alias(f"b{k}") for k, keep in enumerate((keep0, "true", "true", "true"))))
    none = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"
    found = materialise(blocks.select("doc_id", *(F.expr(f"if(b{k} is null, {none}, {_joined(f'b{k}')})").alias(f"s{k}") for k in range(4)), F.monotonically_increasing_id().alias("row")))

    tokens = found.select("*", F.expr("transform(s3, t -> t.value)").alias("tokens"))
    # the battery runs once per distinct token; results join back by token
    tested = tokens.select(F.explode("tokens").alias("token")).distinct()
    for name, sql in _battery("token").items():
        tested = tested.withColumn(name, F.expr(sql))
    tested = materialise(
        tested.select(
            "token", F.least(F.floor(F.log2("n") * 2), F.lit(24)).cast("int").alias("size_class"),
            F.least(F.floor(F.coalesce("bits", F.lit(0.0)) / BIN_WIDTH), F.lit(BINS - 1)).cast("int").alias("bin"),
            F.expr("token rlike '^[A-Z]?[a-z]+$' or token rlike '^[A-Z]+$'").alias("plain"),
        )
    )
    counts = tested.groupBy("size_class", "plain", "bin").agg(F.count("*").alias("tokens"))
    up = Window.partitionBy("size_class", "plain").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("size_class", "plain")
    p = F.pow(F.lit(2.0), -F.col("bin") * BIN_WIDTH)
    passed = counts.withColumn("ok", p * F.sum("tokens").over(whole) <= rate * F.sum("tokens").over(up))
    limits = passed.where("ok").groupBy("size_class", "plain").agg(F.min("bin").alias("limit"))  # 50 rows at most
    random = materialise(tested.join(F.broadcast(limits), ["size_class", "plain"]).where("bin >= limit").select("token"))
    hits = join_hot(found.select("row", F.explode("s3").alias("s")).select("row", "s", F.col("s.value").alias("token")), random, "token", "row")
    added = hits.groupBy("row").agg(F.collect_list("s").alias("added"))
    joined = found.join(added, "row", "left")
    base = F.concat("s0", "s1", "s2")
    return joined.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, F.coalesce("added", F.expr(none)))).alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    names = "array('" + "', '".join(KINDS) + "')"
    text = lambda c: f"array_join(transform({c}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"
    number = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)")
    return secret_spans(docs).select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(F.expr(text("base")).cast("binary"), 256).alias("base_sha256"), F.expr(text("spans")).alias("spans"),
    )
