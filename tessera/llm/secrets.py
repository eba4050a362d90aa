"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds are reported wherever they stand. Weak candidates (user names, endpoints, long base64 runs) are reported
only where the parts they need stand within SCOPE code points: a user name needs a secret, a base64 run an
identifier, an endpoint both. The interval join of each candidate with the nearest part of every role, before and
after it, is a pair of running extremes over the document's candidates, so its cost is linear in them. Weak spans that
overlap a base span are dropped.

Java's split and find agree on leftmost, non-overlapping matches; the lengths of the pieces between matches and of
the matches give positions in code points.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, same, unused

SCOPE = 200
MASK = "[SECRET]"


class Kind(NamedTuple):
    name: str
    role: str
    base: bool
    pattern: str
    gates: tuple[str, ...]  # a match holds one of these, in lower case; none: the pattern itself is the gate


# Patterns of the kinds, base ones first.
KINDS = (
    Kind("assign", "secret", True, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "apikey", "api_key")),
    Kind("access", "identifier", True, r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Kind("hex", "secret", True, r"[0-9a-f]{24,}", ()),
    Kind("user", "identifier", False, r"""(?i:username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", ("user", "login", "client", "account")),
    Kind("endpoint", "endpoint", False, r"""https?://[A-Za-z0-9][^\x20\x09-\x0D"'<>]{3,}""", ("://",)),
    Kind("blob", "secret", False, r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}", ()),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _matches(text: Column, low: Column, k: Kind) -> Column:
    """Number, length of the piece before, own length and validity of each match of one kind."""
    gate = text.rlike(k.pattern)
    if k.gates:
        gate = F.contains(low, F.lit(k.gates[0]))
        for g in k.gates[1:]:
            gate = gate | F.contains(low, F.lit(g))
    whole = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(1)) if k.name == "assign" else whole
    pieces = F.split(text, k.pattern, -1)
    rows = F.transform(F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(pieces, 1, F.greatest(F.size(whole), F.lit(0))).alias("p")), lambda z, i: F.struct(F.lit(ORDER[k.name]).alias("kind"), i.alias("i"), F.length(z["p"]).alias("gap"), F.length(z["m"]).alias("len"), (F.length(z["v"]) >= 6).alias("ok")))
    return F.when(gate, rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, kind, start, end, base: reported spans of distinct rows (by doc_id and th), in code points."""
    source = keyed(docs).where("text is not null").withColumn("low", F.lower("text"))
    found = source.select("doc_id", "th", F.explode_outer(F.concat(*(_matches(F.col("text"), F.col("low"), k) for k in KINDS))).alias("m")).where("m is not null").select("doc_id", "th", "m.*").distinct()
    row = Window.partitionBy("doc_id", "th", "kind").orderBy("i")
    ends = F.sum(F.col("gap") + F.col("len")).over(row)
    placed = found.withColumn("end", ends).withColumn("start", F.col("end") - F.col("len")).where("ok")
    role = F.element_at(F.array(*(F.lit(k.role) for k in KINDS)), F.col("kind") + 1)
    placed = placed.withColumn("role", role).withColumn("base", F.col("kind") < sum(k.base for k in KINDS))
    order = Window.partitionBy("doc_id", "th").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def close(name: str) -> Column:
        last = F.max(F.when(F.col("role") == name, F.col("end"))).over(before)
        following = F.min(F.when(F.col("role") == name, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= SCOPE, F.lit(False)) | F.coalesce(following - F.col("end") <= SCOPE, F.lit(False))

    overlap = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end"), F.lit(False))
    judged = placed.select("doc_id", "th", "kind", "start", "end", "base", "role", close("secret").alias("s"), close("identifier").alias("d"), overlap.alias("overlap"))
    needs = F.when(F.col("role") == "secret", F.col("d")).when(F.col("role") == "identifier", F.col("s")).otherwise(F.col("s") & F.col("d"))
    return judged.where(F.col("base") | (needs & ~F.col("overlap"))).select("doc_id", "th", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base")


def _joined(only_base: bool) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    own = F.array_sort(F.collect_list(F.when(F.col("base") | F.lit(not only_base), F.struct("start", "kind", "end"))))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, th: a row for each input row.

    Null or empty text has no spans; very long texts are scanned whole. Spans that begin at one place come in the order
    of kinds. Repeated rows get equal results, extra columns are ignored; an empty table gives no rows.
    """
    counts = [F.count(F.when(F.col("kind") == i, True)).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    own = spans(docs).groupBy("doc_id", "th").agg(*counts, _joined(True).alias("base_spans"), _joined(False).alias("spans"))
    s, x = keyed(docs).select("doc_id", "th").alias("s"), own.alias("x")
    out = s.join(x, same(F.col("s.doc_id"), F.col("x.doc_id")) & (F.col("s.th") == F.col("x.th")), "left")
    zero = [F.coalesce(F.col(f"x.n_{k.name}"), F.lit(0)).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return out.select("s.doc_id", *zero, F.sha2(F.coalesce("x.base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("x.spans", F.lit("")).alias("spans"), "s.th")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span of text replaced by MASK, overlapping ones by one; all columns stay.

    Rows and nulls stay as they are where nothing is found; repeated rows are masked alike.
    """
    before = Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    own = spans(docs).withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    # pieces of text that stay lie between the end of all spans so far and the next start
    id_, th, cuts, end = unused(docs, "masked_id", "masked_th", "masked_cuts", "masked_end")
    own = own.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.array_sort(F.collect_list(F.when(F.col("from") <= F.col("start"), F.struct("start", "from")))).alias(cuts), F.max("end").alias(end))
    text = F.col("text")
    pieces = F.transform(cuts, lambda c: F.substring(text, (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")))
    left = F.concat(F.array_join(pieces, MASK), F.lit(MASK), F.substring(text, F.col(end).cast("int") + 1, F.length(text)))
    match = same(F.col("doc_id").cast("long"), F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    return docs.join(own, match, "left").withColumn("text", F.when(F.col(cuts).isNotNull(), left).otherwise(text)).select(*docs.columns)
