"""The operators' queries, with production parameters, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .class_lm import class_scores
from .common import table
from .decontaminate import decontaminate
from .licenses import license_scan
from .minhash import near_duplicates
from .packing import pack
from .quality import classify
from .secrets import KINDS, SCOPE, find_secrets
from .spotsigs import fingerprints
from .substring import remove_repeats
from .url_filter import judge

# Rules of the URL filter, as verdict, host and path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
# The query's blocklist of hosts, as names of sites under each of the example domains, and of sections, as host and path.
BAD_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BAD_DOMAINS = ("example.com", "example.net", "example.org")
BAD_SECTIONS = (("example.org", "/fr/9"), ("example.net", "/es/1"), ("tionsh.example.com", "/fr/"))
URL_LIST = [*((f"{s}.{d}", "") for s in BAD_SITES for d in BAD_DOMAINS), *BAD_SECTIONS]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, numerator=85).drop("th", "root")


def op2_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th", "items")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("th")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES, spark.createDataFrame(URL_LIST, "host string, path string"))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), target=35).drop("th")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_winnow_decontamination, op3_license_scan, op4_best_fit_packing, op5_class_lm, op6_secret_scan, op7_url_filter, op8_quality_pu, op9_substring_dedup, op10_spotsigs)}

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]+"
_LETTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, between: str) -> str:
    return f"list_filter(string_split_regex({text}, '{between}'), lambda x: x <> '')"


def _secret_kinds() -> str:
    """Rows doc_id, kind, i, gap, len, ok of every match; a leftmost run of its characters never begins inside a longer one, so blob needs no look-behind."""
    out = []
    for i, k in enumerate(KINDS):
        p = k.pattern.removeprefix("(?<![A-Za-z0-9+/])").replace("'", "''")
        value = f"length(regexp_extract_all(t, '{p}', 1)[i]) >= 6" if k.name == "assign" else "true"
        out.append(f"select doc_id, {i} as kind, i, length(string_split_regex(t, '{p}')[i]) as gap, length(regexp_extract_all(t, '{p}')[i]) as len, {value} as ok from (select doc_id, t, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) as i from d)")
    return " union all ".join(out)


def _close(role: str) -> str:
    kinds = ", ".join(str(i) for i, k in enumerate(KINDS) if k.role == role)
    return f"coalesce(s - max(case when kind in ({kinds}) then e end) over before <= {SCOPE}, false) or coalesce(min(case when kind in ({kinds}) then s end) over after - e <= {SCOPE}, false)"


_NAMES = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
_N_BASE = sum(k.base for k in KINDS)
_ROLE = "[" + ", ".join(f"'{k.role}'" for k in KINDS) + "]"

ORACLES = {
    "op6_secret_scan": f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({_secret_kinds()}),
p as (select * from (select doc_id, kind, ok, len, cast(sum(gap + len) over (partition by doc_id, kind order by i) as bigint) as e from m) where ok),
q as (select doc_id, kind, e - len as s, e from p),
j as (select doc_id, kind, s, e, {_close("secret")} as near_secret, {_close("identifier")} as near_identifier,
  coalesce(max(case when kind < {_N_BASE} then e end) over before > s, false) or coalesce(min(case when kind < {_N_BASE} then s end) over after < e, false) as overlap
  from q window before as (partition by doc_id order by s, kind rows between unbounded preceding and 1 preceding), after as (partition by doc_id order by s, kind rows between 1 following and unbounded following)),
r as (select doc_id, kind, s, {_NAMES}[kind + 1] || ':' || s || ':' || e as x from j where kind < {_N_BASE} or not overlap
  and case {_ROLE}[kind + 1] when 'secret' then near_identifier when 'identifier' then near_secret else near_secret and near_identifier end),
g as (select doc_id, count(*) filter (where kind = 0) as a, count(*) filter (where kind = 1) as b, count(*) filter (where kind = 2) as c,
  string_agg(x, ',' order by s, kind) filter (where kind < {_N_BASE}) as base, string_agg(x, ',' order by s, kind) as every from r group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans
from d left join g on g.doc_id = d.doc_id""",
    "op1_minhash_dedup": f"""
with recursive d as (select doc_id, {_words(_LOW.format("text"), _BLANK)} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.c as component_id, s.doc_id = r.c as kept
from s join (select a, min(b) as c from reach group by a) r on r.a = s.doc_id""",
    "op2_winnow_decontamination": f"""
with i as (select cast(item_id as varchar) as item_id, {_words(_LOW.format("text"), _LETTERS)} as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) as v from i where len(w) > 0),
d as (select doc_id, {_words(_LOW.format("text"), _LETTERS)} as w from documents),
p as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw) where len(w) >= n),
m as (select p.doc_id, p.k, p.n, iw.item_id from p join iw on iw.n = p.n and iw.v = array_to_string(p.w[p.k:p.k + p.n - 1], ' ')),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, k + n)) as x from m) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""",
    "op7_url_filter": f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as r from pages),
h as (select page_id, {_LOW.format("regexp_extract(r, '^([^/?#]*)', 1)")} as host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from u),
rules(v, rh, rp) as (values {", ".join(str(r) for r in URL_RULES)}),
f as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v from h, rules
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
listed(lh, lp) as (values {", ".join(str(x) for x in URL_LIST)}),
b as (select distinct page_id from h, listed where (host = lh or ends_with(host, '.' || lh)) and starts_with(path, lp))
select h.page_id, h.host, h.path, f.rule, coalesce(f.v, case when b.page_id is not null then 'block' else 'allow' end) as verdict
from h left join f on f.page_id = h.page_id left join b on b.page_id = h.page_id""",
    "op9_substring_dedup": f"""
with d as (select doc_id, {_words("coalesce(text, '')", _BLANK)} as w from documents),
p as (select doc_id, k, md5(array_to_string(w[k:k + 34], ' ')) as v from (select doc_id, w, unnest(range(1, len(w) - 33)) as k from d where len(w) >= 35)),
r as (select v from p group by v having count(*) > 1),
g as (select doc_id, list(distinct x) as xs from (select doc_id, unnest(range(k, k + 35)) as x from p where v in (select v from r)) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(len(g.xs), 0) as bigint) as n_removed,
  sha256(array_to_string(case when g.xs is null then d.w else (select coalesce(list(d.w[k] order by k), []) from (select unnest(range(1, len(d.w) + 1)) as k) where not list_contains(g.xs, k)) end, ' ')) as kept_sha256
from d left join g on g.doc_id = d.doc_id""",
}
