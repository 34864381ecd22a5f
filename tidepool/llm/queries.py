"""The operators' queries over whole tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import centroids, linedup, minhash, packing, quality, repeats, resampling, rpforest, secrets, sentencepieces, shards, urls, wordbpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages")).drop("component")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[0]


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.train(secrets.labelled_samples(spark)))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, secrets.listed(F.col("spans")).alias("spans"))


def _little_endian(ids: str) -> Column:
    """Ids as little-endian unsigned 32-bit numbers: their hex digits' pairs turned round."""
    digits = F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.unhex(F.regexp_replace(digits, "(..)(..)(..)(..)", "$4$3$2$1"))


def op9_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wordbpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(_little_endian("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return rows.withColumn("centroid_sha256", digest).drop("centroid")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pack, op2_quality, op3_urls, op4_shards, op5_minhash, op6_repeats, op7_lines, op8_secrets, op9_words, op10_vectors, op11_resample, op12_pieces, op13_centroids, pipeline)
    return {f.__name__: f for f in own}


#: Words of a text ``t``, as a list.
WORDS = "list_filter(string_split(translate(t, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '')"
BLANK = "translate(l, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')"

QUALITY = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, coalesce(source, '') h from documents),
w as (select rid, {WORDS} ws from d),
g as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] g from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from g) where c > 1),
cov as (select rid, count(distinct j) n from (select rid, unnest([i, i+1, i+2]) j from r) group by rid),
l as (select rid, h, t, unnest(string_split(t, chr(10))) l from d),
own as (select rid, h, t whole, l, {WORDS.replace("translate(t,", "translate(l,")} ws from l where {BLANK} <> ''),
lines as (select *, translate(lower(array_to_string(ws, ' ')), '123456789', '000000000') norm from own),
dup as (select rid, count(*) - count(distinct l) n from lines group by rid),
texts as (select h, count(distinct whole) texts from lines group by h),
freq as (select h, norm from (select h, norm, count(distinct whole) n from lines group by h, norm) join texts using (h)
         where n > {quality.MAX_DOCS} and n > texts * {quality.MAX_SHARE}),
gone as (select rid, sum(len(ws)) n from lines join freq using (h, norm) group by rid),
s as (select doc_id, len(ws) n_words, length({BLANK.replace("translate(l,", "translate(t,")}) word_chars,
      length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, coalesce(dup.n, 0) n_dup_lines,
      coalesce(cov.n, 0) n_repeat_words, coalesce(gone.n, 0) words_removed
      from d join w using (rid) left join dup using (rid) left join cov using (rid) left join gone using (rid)),
f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed from s)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
  not base_failed and n_words - words_removed >= {quality.MIN_LEFT} * n_words kept, cast(words_removed as bigint) words_removed from f
"""

URL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

#: An address ``u`` as a node of the alias graph.
NODE = r"""case when regexp_matches(u, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') then
  lower(regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
  case lower(regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) when 'http' then regexp_replace(lower(regexp_extract(u, '(?s)://([^/?]*)', 1)), ':80$', '')
    when 'https' then regexp_replace(lower(regexp_extract(u, '(?s)://([^/?]*)', 1)), ':443$', '') else lower(regexp_extract(u, '(?s)://([^/?]*)', 1)) end ||
  case when starts_with(regexp_replace(u, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '/') then '' else '/' end || regexp_replace(u, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '')
  else u end"""


def _node(url: str) -> str:
    return f"(select {NODE} from (select regexp_replace({url}, '(?s)#.*$', '') u))"


URLS = rf"""
with recursive rules(v, h, p) as (values {URL_RULES}),
tags as (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) tag from pages),
raw as (select url, case when regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') then regexp_extract(tag, '(?is)^<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  when regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)^<meta\b[^>]*\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1) else '' end link from tags),
cut as (select url, regexp_replace(trim(replace(link, '&amp;', '&')), '(?s)#.*$', '') link, regexp_extract(url, '(?s)^([^:/?#]*)://', 1) scheme,
  regexp_extract(url, '(?s)^[^:/?#]*://[^/?#]*') site, regexp_extract(url, '(?s)^[^?#]*') page from raw where link <> ''),
whole as (select url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then scheme || ':' || link when starts_with(link, '/') then site || link
  when starts_with(link, '?') then page || link when link <> '' then case when length(page) > length(site) then regexp_extract(page, '(?s)^.*/') else site || '/' end || link end link from cut),
links as (select distinct {_node("url")} src, {_node("link")} dst from whole where url is not null and link is not null),
both_ways as (select src, dst from links where src <> dst union select dst, src from links where src <> dst),
reach(node, root) as (select src, src from both_ways union select e.dst, r.root from reach r join both_ways e on e.src = r.node),
parts as (select node, min(root) component from reach group by node),
own as (select distinct url, {_node("url")} node from pages),
u as (select url from own union select node from parts),
s as (select url, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0, 's') else '' end rest from u),
hp as (select url, coalesce(translate(regexp_extract(rest, '^[^/]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(substr(rest, length(regexp_extract(rest, '^[^/]*', 0, 's')) + 1), '') path from s),
best as (select url, arg_max(rules.h || p, length(rules.h || p)) rule, arg_max(v, length(rules.h || p)) v from hp
  join rules on (host = rules.h or ends_with(host, '.' || rules.h)) and starts_with(path, p) group by url),
decided as (select component, bool_or(v = 'allow') or not bool_or(v = 'block') ok from parts left join best on best.url = parts.node group by component)
select page_id, coalesce(hp.host, '') host, coalesce(hp.path, '') path, best.rule, coalesce(best.v, case when coalesce(ok, true) then 'allow' else 'block' end) verdict
from pages left join hp on hp.url = pages.url left join best on best.url = pages.url left join own on own.url = pages.url
left join parts on parts.node = own.node left join decided using (component)
"""

#: Components of links ``e(a, b)`` in both directions.
REACH = "reach(node, root) as (select a, a from e union select e.b, r.root from reach r join e on e.a = r.node), parts as (select node, min(root) c from reach group by node)"

MINHASH = f"""
with recursive d as (select doc_id, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') t from documents),
w as (select doc_id, {WORDS} ws from d),
g as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then ws else
  list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]) end) g from w),
s as materialized (select distinct doc_id, g from g), n as (select doc_id, count(*) n from s group by doc_id),
k as materialized (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as materialized (select a, b from k join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
{REACH}
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, coalesce(c, d.doc_id) component_id, d.doc_id = coalesce(c, d.doc_id) kept
from d left join n using (doc_id) left join parts on parts.node = d.doc_id
"""

LINES = f"""
with d as (select row_number() over () rid, doc_id, text, coalesce(source, '') h from documents),
l as (select rid, h, i, ls[i] l, trim(ls[i]) x from (select rid, h, ls, unnest(range(1, len(ls) + 1)) i from (select rid, h, string_split(text, chr(10)) ls from d where text is not null))),
totals as (select h, count(*) total from d group by h),
found as (select h, x from (select h, x, count(distinct rid) n from l where {BLANK} <> '' group by h, x) join totals using (h)
  where n >= {linedup.MIN_PAGES} and n > total * {linedup.MAX_RATIO}),
k as (select rid, count(*) filter (where {BLANK} <> '') n_lines, count(*) filter (where found.x is not null) n_dropped,
  string_agg(l, chr(10) order by i) filter (where found.x is null) t from l left join found on found.h = l.h and found.x = l.x group by rid)
select doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_dropped, 0) as bigint) n_dropped, md5(coalesce(t, '')) text_md5 from d left join k using (rid)
"""

VECTORS = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) x from embeddings where label is not null and len(embedding) > 0),
e as materialized (select p.vec_id a, q.vec_id b from v p join v q on p.label = q.label and p.vec_id <> q.vec_id and list_cosine_similarity(p.x, q.x) >= {rpforest.THRESHOLD}),
{REACH}, n as (select a, count(*) n from e group by a)
select vec_id, cast(coalesce(n, 0) as bigint) n_links, coalesce(c, vec_id) component_id, vec_id = coalesce(c, vec_id) kept
from embeddings left join n on n.a = vec_id left join parts on parts.node = vec_id
"""


def _nibbles() -> list[int]:
    """CRC-32 of each four bits, from its polynomial."""
    out = list(range(16))
    for _ in range(4):
        out = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in out]
    return out


#: CRC-32 of a text ``g`` in UTF-8, four bits after another, the lower ones of a byte first.
CRC32 = f"""xor(list_reduce(list_transform(range(0, 2 * octet_length(encode(g))), lambda i: instr('0123456789ABCDEF', substr(hex(encode(g)), cast(i + 2 - 2 * (i % 2) as int), 1)) - 1),
  lambda c, b: xor(c // 16, ({_nibbles()})[cast(xor(c, b) & 15 as int) + 1]), 4294967295), 4294967295)"""


def _word_lists(table: str) -> str:
    lower = "coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    return f"select row_number() over () id, *, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from {table}"


def _runs(table: str) -> str:
    """Runs ``g`` of one to three words."""
    two, three = "ws[i] || ' ' || ws[i+1]", "ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]"
    return f"select id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: {two}), list_transform(range(1, len(ws) - 1), lambda i: {three}))) g from {table}"


RESAMPLE = f"""
with d as materialized ({_word_lists("documents")}), b as materialized ({_word_lists("benchmark")}), f as materialized ({_runs("d")}), e as materialized ({_runs("b")}),
known as materialized (select g, cast({CRC32} % {resampling.BUCKETS} as int) bucket from (select g from f union select g from e)),
own as (select bucket, count(*) s from f join known using (g) group by 1), theirs as (select bucket, count(*) t from e join known using (g) group by 1),
total as (select (select count(*) from f) s, (select count(*) from e) t),
gain as (select every.bucket, cast(floor(1000 * ln((coalesce(theirs.t, 0) + 1e0) * (total.s + {resampling.BUCKETS}) / ((coalesce(own.s, 0) + 1e0) * (total.t + {resampling.BUCKETS})))) as bigint) gain
  from (select unnest(range(0, {resampling.BUCKETS})) bucket) every left join own using (bucket) left join theirs using (bucket) cross join total),
weights as (select id, count(*) n, sum(gain) w from f join known using (g) join gain using (bucket) group by id),
scored as (select d.doc_id, len(ws) n_words, coalesce(n, 0) n_features, cast(coalesce(w, 0) as bigint) weight, cast(coalesce(w, 0) as bigint)
  + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) as bigint) + 0.5e0) / 4294967296e0))) as bigint) score from d left join weights using (id)),
fit as (select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from scored where n_words >= {resampling.MIN_WORDS})
select scored.doc_id, n_features, weight, score, case when r <= {resampling.PERCENT} * n // 100 then r end "rank" from scored left join fit on fit.doc_id = scored.doc_id and n_words >= {resampling.MIN_WORDS}
"""


def _assigned(n: int) -> str:
    """Each vector's nearest centroid of round ``n``."""
    distance = f"cast(list_sum(list_transform(list_zip(v.q, c{n}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    return f"a{n} as materialized (select rid, min({{'d': d, 'k': k}}) m from (select rid, k, {distance} d from v cross join c{n}) group by rid)"


def _moved(n: int) -> str:
    """Centroids after round ``n``."""
    down = "cast((s - ((s % n) + n) % n) // n as bigint)"
    sums = f"s{n} as materialized (select a{n}.m.k k, i, sum(x) s, count(*) n from a{n} join u using (rid) group by all)"
    return f"{sums}, c{n + 1} as materialized (select c{n}.k, coalesce(f.q, c{n}.q) q from c{n} left join (select k, list({down} order by i) q from s{n} group by k) f using (k))"


CENTROIDS = f"""
with v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor({centroids.SCALE} * cast(x as double)) as bigint)) q from embeddings
  where len(embedding) = {centroids.WIDTH} and len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.WIDTH}),
u as materialized (select rid, unnest(q) x, generate_subscripts(q, 1) i from v),
c0 as materialized (select row_number() over (order by h, q) - 1 k, q from (select sha256('{centroids.SEED}:' || vec_id) h, q from v) order by h, q limit {centroids.K}),
{", ".join(f"{_assigned(n)}, {_moved(n)}" for n in range(centroids.ROUNDS))}, {_assigned(centroids.ROUNDS)}
select vec_id, cast(m.k as int) "cluster", m.d distance, cast(sum(m.d) over (partition by m.k) as bigint) cluster_inertia, cast(sum(m.d) over () as bigint) inertia,
  sha256(array_to_string(c{centroids.ROUNDS}.q, ',')) centroid_sha256 from v join a{centroids.ROUNDS} using (rid) join c{centroids.ROUNDS} on c{centroids.ROUNDS}.k = m.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": QUALITY, "op3_urls": URLS, "op5_minhash": MINHASH, "op7_lines": LINES, "op10_vectors": VECTORS, "op11_resample": RESAMPLE, "op13_centroids": CENTROIDS}
