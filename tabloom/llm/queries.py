"""The registered queries: each applies one operator to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import contamination, embeddings, html, lines, mixing, prefix_trie, quality, secrets, simhash, spelling, toxicity, urls, weak_rules
from tabloom.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents at 3 or fewer differing bits of 3-word shingles."""
    rows, _ = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return rows.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id",
                       F.col("kept").alias("is_kept"))


OP6_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT as size from documents),
s as (select source, sum(size)::BIGINT as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::INT]::DOUBLE as weight, 2.0 * source_size::DOUBLE as cap from s),
o as (select *, row_number() over (order by cap / weight, source nulls last) as k,
  1.5::DOUBLE * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as free from w),
p as (select min(k) as k from o where rest * weight / free <= cap),
q as (select o.rest, o.free, o.k from o join p using (k)),
t as (select o.source, o.source_size, case when o.k < q.k then o.cap else q.rest * o.weight / q.free end as target from o left join q on true),
u as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
  sum(d.size) over (partition by d.source order by md5('6|mix|' || d.doc_id)[1:13], d.doc_id) as upto
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, coalesce(target, 2.0 * source_size)::DOUBLE as target,
  (size * (whole + case when source_size > 0 and target - whole * source_size > 0 and upto - size / 2.0::DOUBLE <= target - whole * source_size then 1 else 0 end))::BIGINT as taken
from u
"""


@query("op6_mixing", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document: weights 5, 2, 1, 150 % of all words, two passes at most."""
    rows = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=6)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP7_SQL = r"""
with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from d),
c as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, c.key is not null as gone from k left join c using (key))
select doc_id, count(*)::BIGINT as n_lines, (count(*) filter (where gone))::BIGINT as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


@query("op7_lines", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 of them hold."""
    docs = table(spark, sf_dir, "documents")
    kept = lines.LineIndex.build(docs, min_docs=10, min_chars=1).clean(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model of the rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_contamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in documents, with the share of an exact copy's score and the words they span."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination.Decontaminator.fit(docs, bench).pairs(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a positive-unlabelled model of the rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_embeddings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 and their components for all embeddings."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95).withColumnRenamed("id", "vec_id")


#: Rules of the contract, then words that mark junk hosts and paths.
URL_RULES = (urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
             urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"))
URL_GLOBS = tuple(urls.Glob("block", f"*{w}*") for w in ("casino", "pills", "free-bets", "spam", "ads-track"))

OP4_SQL = r"""
with a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from b),
r(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f as (select c.*, r.h || r.p as rule, r.verdict, row_number() over (partition by page_id order by length(r.h || r.p) desc nulls last) as k
  from c left join r on (c.host = r.h or ends_with(c.host, '.' || r.h)) and starts_with(c.path, r.p))
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  coalesce(verdict, case when regexp_matches(host || path, 'casino|pills|free-bets|spam|ads-track') then 'block' else 'allow' end) as verdict
from f where k = 1
"""


@query("op4_urls", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for the URL of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents: counts and digest of the fixed patterns, and the list of all spans."""
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "novel")
    return rows.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
                       listed(F.col("found")).alias("spans"))


@query("op8_html")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = html.extract(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


OP13_SQL = r"""
with own as (select conv_id as c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, role, text) as turns
  from conversations where conv_id is not null group by conv_id),
crc as (select c, turns, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: xor(s >> 1, 3988292384::BIGINT * (s & 1))))) % 9 as h from own),
full_ as (select a.c, coalesce(list_slice(b.turns, 1, a.h), []) || list_slice(a.turns, a.h + 1, len(a.turns)) as turns
  from crc a left join own b on b.c = a.c - a.c % 5),
rows_ as (select c, len(turns) as length, d, md5(to_json(list_slice(turns, 1, d))::VARCHAR) as key, case when d > 0 then strlen(turns[d].t) else 0 end as bytes
  from (select *, unnest(range(0, len(turns) + 1)) as d from full_)),
nodes as (select d, key, min(c) as node, count(*) as n, max(bytes) as bytes, max(length) = d as leaf, string_agg(c::VARCHAR, ',' order by c) filter (where length = d) as ends from rows_ group by d, key),
passed as (select r.c, r.d, n.node, n.n, lag(n.node) over (partition by r.c order by r.d) as parent,
  sum(case when r.c = n.node then (n.n - 1) * n.bytes else 0 end) over (partition by r.c order by r.d desc) as saved,
  sum(case when r.c = n.node and n.leaf then 1 else 0 end) over (partition by r.c order by r.d desc) as leaves, n.ends
  from rows_ r join nodes n using (d, key)),
totals as (select d, node, sum(saved) as saved, sum(leaves) as leaves, max(ends) as ends, max(n) as n from passed group by d, node),
edges as (select d, c as node, parent from passed where c = node),
kids as (select d - 1 as d, parent as node, count(*) as n from edges where d > 0 group by all)
select t.node::BIGINT as conv_id, t.d::BIGINT as depth, e.parent::BIGINT as parent_conv_id, t.n::BIGINT as n_convs, coalesce(k.n, 0)::BIGINT as n_children,
  t.leaves::BIGINT as n_leaves, t.saved::BIGINT as saved_tokens, sha256(coalesce(t.ends, '')) as ends_sha256
from totals t join edges e using (d, node) left join kids k using (d, node)
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each rebuilt on the first turns of the first one of its five."""
    turns = prefix_trie.conversation_turns(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(*prefix_trie.with_shared_head(turns, group=5, heads=9))
    return nodes.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id"})


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, and whether the weighed votes of the rules make a document a good one."""
    rows = weak_rules.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & (F.col("probability") >= 0.5)).alias("kept"), "probability")


OP11_SQL = r"""
with runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select coalesce(doc_id::VARCHAR, '') || ':' as pre, run, count(*) as n from runs group by all),
crc as (select *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(pre || run)), lambda i: ('0x' || substr(hex(encode(pre || run)), 2 * i::INT + 1, 2))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: xor(s >> 1, 3988292384::BIGINT * (s & 1))))) as h from counted),
noisy as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) else run end as word, n from crc),
v as (select word, sum(n)::BIGINT as n from noisy where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, length(word) as l, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (select distinct a.word, b.word as other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.l = b.l and a.word <> b.word
  union select a.word, b.word, b.n from cut a join v b on a.rest = b.word union select b.word, a.word, a.n from cut a join v b on a.rest = b.word),
near as (select word, count(*) as n_near, max(n) as top_n, arg_min(other, (-n, other)) as top from pairs group by word),
forms as (select v.word, v.n, coalesce(n_near, 0)::BIGINT as n_near, case when top_n >= 2 * v.n then top end as form, case when top_n >= 2 * v.n then top_n end::BIGINT as form_n from v left join near using (word)),
chain as (with recursive c(word, here, k) as (select word, word, 0 from forms union all select c.word, f.form, c.k + 1 from c join forms f on f.word = c.here where f.form is not null) select word, arg_max(here, k) as root from c group by word)
select word, form, root, n, n_near, form_n from forms join chain using (word)
"""


@query("op11_spelling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants: near words, the frequent form, and the root of its chain."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), min_chars=5, min_count=3, noise=97)
    return spelling.spelling_groups(words, times=2)
