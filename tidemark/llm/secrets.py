"""Secret scans: strong patterns on their own, weak ones only where complementary parts of a credential meet.

Strong (base) kinds are reported as found: assign, access, hex. Weak candidates are identifiers (key_id, and login:
an assigned user, account or client name, or an e-mail address), secrets (key_secret) and endpoints. A weak candidate
counts only if what completes it lies within ``scope`` code points of it in the same text, outside of its own span: a
secret needs an identifier or an endpoint, an identifier needs a secret, an endpoint needs both. Strong kinds complete
weak ones: access as identifier; assign and hex as secrets. So an address alone is no finding; one beside a token is.

The text is read once, into arrays of spans. Spans of documents that have a weak candidate become rows; the interval
join is an equi-join on document and cell (cells are as long as the scope; a span lies in each cell it reaches) with
the exact distance as condition, as a semi-join: a candidate comes out once however many parts complete it. A cell
holds few spans, since spans of a kind don't overlap, so no document makes a quadratic number of comparisons.

Defined results: null and empty texts have no spans. Texts of any length are searched whole. Spans that start together
come in the order of KINDS. Repeated rows get equal results. An empty table gives no rows. Columns other than doc_id and
text are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_of

# The base patterns, and the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Weak parts of credentials.
KEY_ID = r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{11,}+(?![A-Za-z0-9])"
KEY_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_=-]*[0-9])(?=[^A-Z\s]*[A-Z])(?=[^a-z\s]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
LOGIN = r"""(?:(?<![A-Za-z0-9])(?i:user(?:_?name|_?id)?|login|account(?:_?(?:name|id))?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"""
ENDPOINT = r"(?<![A-Za-z0-9.@-])(?:https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?:[a-z0-9-]{1,63}\.){1,8}(?:com|net|org|io|cloud|internal|local)(?::[0-9]{1,5})?)(?![A-Za-z0-9-])"

BASE = ("assign", "access", "hex")
WEAK = ("key_id", "login", "key_secret", "endpoint")
KINDS = BASE + WEAK
SCOPE = 200

_SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Where the pattern's leftmost non-overlapping matches lie, without those whose group is shorter than least.

    Matches are the gaps between the pieces that a split leaves, so their lengths give the positions. Most texts
    have no match, and are not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)),
        F.transform(found, lambda m: F.struct(F.length(m).alias("n"), F.length(F.regexp_extract(m, pattern, group) if group else m).alias("key"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["key"].alias("key")),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        b = a + F.coalesce(x["n"], F.lit(0))
        return F.struct(b.alias("at"), F.when(x["key"] >= least, F.concat(s["out"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(s["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(sized, start, step, lambda s: s["out"])).otherwise(F.array().cast(_SPANS))


def _hex_spans(text: Column) -> Column:
    """Maximal runs of LEAST or more: what is left of the hex pattern's matches once short ones are dropped."""
    return spans(text, rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes that tell the document, and an array of spans for each kind."""
    t = text_of()
    own = docs.select(F.col("doc_id"), t.alias("_t"), F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("_k2"))
    t = F.col("_t")
    found = {
        "assign": spans(t, ASSIGN, LEAST["assign"], 2),
        "access": spans(t, ACCESS, LEAST["access"]),
        "hex": _hex_spans(t),
        "key_id": spans(t, KEY_ID),
        "login": spans(t, LOGIN),
        "key_secret": spans(t, KEY_SECRET),
        "endpoint": spans(t, ENDPOINT),
    }
    return own.select("doc_id", "_k1", "_k2", *[found[k].alias(k) for k in KINDS])


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_k1, _k2, kind, start, end) of the weak candidates that complementary parts complete."""
    some = found.where(F.greatest(*[F.size(k) for k in WEAK]) > 0)

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    each = F.concat(*[tagged(k) for k in KINDS])
    rows = some.select("_k1", "_k2", F.explode(each).alias("s")).select("_k1", "_k2", "s.*").distinct()

    def cells(df: DataFrame, reach: int) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope))))

    def near(left: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Candidates with a part of one of the kinds, other than a strong span over the same place, in reach."""
        right = cells(rows.where(F.col("kind").isin(*kinds)), 0).select(*[F.col(c).alias(f"r{c}") for c in ("_k1", "_k2", "_cell", "start", "end")])
        left = cells(left, scope)
        apart = (F.col("rstart") >= F.col("end")) | (F.col("rend") <= F.col("start"))
        reach = (F.col("rstart") <= F.col("end") + scope) & (F.col("rend") >= F.col("start") - scope)
        on = (F.col("_k1") == F.col("r_k1")) & (F.col("_k2") == F.col("r_k2")) & (F.col("_cell") == F.col("r_cell")) & apart & reach
        return left.join(right, on, "left_semi").select("_k1", "_k2", "kind", "start", "end").distinct()

    identifiers, secrets = ("access", "key_id", "login"), ("assign", "hex", "key_secret")
    of = {k: rows.where(F.col("kind") == k) for k in WEAK}
    got = [near(of["key_secret"], (*identifiers, "endpoint")), near(of["key_id"].union(of["login"]), secrets), near(near(of["endpoint"], identifiers), secrets)]
    return reduce(DataFrame.unionByName, got)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, an array of spans for each base kind, and ``all``: every reported span as (start, order, kind, end)."""
    found = cut(parts(docs), "spans")
    weak = linked(found, scope).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_weak"))
    joined = found.join(weak, ["_k1", "_k2"], "left")

    def listed(k: str, array: Column) -> Column:
        return F.transform(array, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("order"), F.lit(k).alias("kind"), s["end"].alias("end")))

    base = [listed(k, F.col(k)) for k in BASE]
    own = F.coalesce("_weak", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    weak_ = F.transform(own, lambda s: F.struct(s["start"].alias("start"), (F.array_position(F.lit(list(KINDS)), s["kind"]) - 1).cast("int").alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
    return joined.select("doc_id", *BASE, F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*base, weak_)).alias("all"))


def joined_spans(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
