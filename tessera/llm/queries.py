"""The queries of the operators over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, centroids, chat, decontaminate, jaccard, licences, media, mixing, ngram, phrases, quality, sharding, units
from tessera.sources.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.telephony_media(_table(spark, sf_dir, "documents"))


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.repeated_units(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "times", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_regions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark, "quality").table(quality.document_statistics(_table(spark, sf_dir, "documents")), "statistics")
    return quality.score_statistics(stats, quality.fit(stats, _table(spark, sf_dir, "labels")))


def op7_licence_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_regions(_table(spark, sf_dir, "documents"))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(_table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ngram.train(docs.where(~ngram.held_out(F.col("doc_id"))), Scratch(spark, "ngram"))
    scored = ngram.score(docs, model)
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score", "perplexity")]
    return scored.select("doc_id", ngram.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *rounded)


def op10_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_roles(_table(spark, sf_dir, "conversations"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path``: the vocabulary file, by default the public one of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = bpe.shared(spark, path)
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary, packed=True)
    counted = encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode_ids(counted, vocabulary, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), Scratch(spark, "phrases"))


def op13_exact_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), Scratch(spark, "centroids")).rows()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_telephony_media, op2_unit_dedup, op3_jaccard_join, op4_source_mix, op5_decontaminate, op6_quality_discriminant, op7_licence_patience, op8_external_shuffle, op9_kneser_ney, op10_role_repair, op11_byte_bpe, op12_phrase_growth, op13_exact_centroids)
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

UNITS_SQL = f"""
with line as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as li from documents),
placed as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by li rows between unbounded preceding and 1 preceding), 0) as lead from line),
piece as (select doc_id, li, lead, unnest(regexp_extract_all(line, '{GAP}*{WORD}')) as piece, generate_subscripts(regexp_extract_all(line, '{GAP}*{WORD}'), 1) as wi from placed),
word as (select doc_id, li, wi, regexp_replace(piece, '^{GAP}+', '') as word, lead + sum(length(piece)) over (partition by doc_id, li order by wi) as e from piece),
cut as (select *, e - length(word) as s, coalesce(sum(case when right(word, 1) in ('.', '!', '?') then 1 else 0 end) over (partition by doc_id, li order by wi rows between unbounded preceding and 1 preceding), 0) as si from word),
marked as (select *, strlen(word) * 31 + cast(concat('0x', left(hex({LOWER.format("word")}), 2)) as int) * 7 + cast(concat('0x', right(hex({LOWER.format("word")}), 2)) as int) * 13 as own from cut),
mark as (select *, (own * 17 + coalesce(lead(own) over (partition by doc_id, li order by wi), 0) * 29) % 1009 as m from marked),
least as (select *, m < coalesce(min(m) over (partition by doc_id, li order by wi rows between {units.REACH} preceding and 1 preceding), 2000) and m <= coalesce(min(m) over (partition by doc_id, li order by wi rows between 1 following and {units.REACH} following), 2000) as opens from mark),
parts as (select *, sum(case when opens and wi > 1 then 1 else 0 end) over (partition by doc_id, li order by wi) as pi from least),
counts as (select doc_id, li, count(distinct si) as sentences, count(distinct pi) as stretches from parts group by 1, 2),
line_u as (select doc_id, 'line' as kind, li, null as si, null as pi, min(s) as s, max(e) as e, count(*) as n, {LOWER.format("string_agg(word, ' ' order by wi)")} as t from parts group by doc_id, li),
sentence_u as (select p.doc_id, 'sentence' as kind, p.li, si, null as pi, min(s) as s, max(e) as e, count(*) as n, {LOWER.format("string_agg(word, ' ' order by wi)")} as t from parts p join counts c on p.doc_id = c.doc_id and p.li = c.li where c.sentences > 1 group by p.doc_id, p.li, si),
stretch_u as (select p.doc_id, 'stretch' as kind, p.li, null as si, pi, min(s) as s, max(e) as e, count(*) as n, {LOWER.format("string_agg(word, ' ' order by wi)")} as t from parts p join counts c on p.doc_id = c.doc_id and p.li = c.li where c.stretches > 1 group by p.doc_id, p.li, pi),
unit as (select * from line_u union all select * from sentence_u union all select * from stretch_u x where not exists (select 1 from sentence_u y where x.doc_id = y.doc_id and x.s = y.s and x.e = y.e)),
ranked as (select *, first_value(doc_id) over w as kept, first_value(s) over w as kept_s, count(*) over (partition by t) as many from unit where n >= {units.MIN_WORDS} window w as (partition by t order by doc_id, s)),
hit as (select *, doc_id <> kept or s <> kept_s as again from ranked where many > 1),
placed_word as (select p.*, row_number() over (partition by p.doc_id order by p.li, wi) as gw, coalesce(l.again, false) as la, coalesce(x.again, false) as sa, coalesce(t.again, false) as ta,
    l.again = false or x.again = false or t.again = false as held, l.kept as lk, l.kept_s as ls, x.kept as xk, x.kept_s as xs, t.kept as tk, t.kept_s as ts
    from parts p left join (select * from hit where kind = 'line') l on p.doc_id = l.doc_id and p.li = l.li left join (select * from hit where kind = 'sentence') x on p.doc_id = x.doc_id and p.li = x.li and p.si = x.si
    left join (select * from hit where kind = 'stretch') t on p.doc_id = t.doc_id and p.li = t.li and p.pi = t.pi),
again_word as (select *, gw - row_number() over (partition by doc_id order by gw) as run from placed_word where la or sa or ta),
long_run as (select *, count(*) over (partition by doc_id, run) as words_run from again_word),
gone as (select *, gw - row_number() over (partition by doc_id order by gw) as piece from long_run where words_run >= {units.MIN_RUN} and held is distinct from true),
cell as (select doc_id, min(s) as s, max(e) as e, count(*) as words, arg_min(case when la then 'line' when sa then 'sentence' else 'stretch' end, gw) as kind, arg_min(case when la then lk when sa then xk else tk end, gw) as kept, arg_min(case when la then ls when sa then xs else ts end, gw) as kept_s from gone group by doc_id, piece)
select c.doc_id, cast(c.s as bigint) as start, cast(c.e as bigint) as "end", c.words, c.kind, c.kept as kept_doc_id, cast(strlen(substr(d.text, 1, cast(c.kept_s as int))) as bigint) as kept_start_byte from cell c join documents d on c.kept = d.doc_id
"""

JACCARD_SQL = f"""
with recursive doc as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as a from documents),
shingle as (select distinct doc_id, unnest(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')] else list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) end) as g from doc),
size as (select doc_id, count(*) as n from shingle group by 1),
met as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingle x join shingle y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
pair as (select m.a, m.b, m.c = x.n and m.c = y.n as same from met m join size x on m.a = x.doc_id join size y on m.b = y.doc_id where 100 * m.c >= 75 * (x.n + y.n - m.c)),
way as (select a, b from pair union all select b, a from pair),
reach(v, c) as (select doc_id, doc_id from documents union select w.b, r.c from reach r join way w on w.a = r.v where r.c < w.b),
least as (select v, min(c) as c from (select v, c from reach) z group by 1)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.c as component_id, coalesce(k.a, d.doc_id) as class_id from documents d left join size s on d.doc_id = s.doc_id join least l on d.doc_id = l.v
left join (select b, min(a) as a from pair where same group by 1) k on d.doc_id = k.b
"""

# CRC-32 of the id's digits by its table, then the model's counts, discounts and sums as in the operator's docstring.
NGRAM_SQL = f"""
with crc as (select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as t),
id as (select doc_id, xor(4294967295, list_reduce(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 7 = 2 as held_out from documents, crc),
split as (select doc_id, list_concat(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}'), [' end']) as a from documents),
token as (select doc_id, unnest(a) as w, unnest(list_concat([' start'], a[:-2])) as u from split),
train as (select u, w from token t join id i on t.doc_id = i.doc_id where not i.held_out),
pair as (select u, w, count(*) as c from train group by 1, 2),
word as (select w, sum(c) as c, count(*) as b from pair group by 1),
total as (select cast(sum(c) as double) as n, cast(count(*) as double) as v, cast(sum(b) as double) as b from word),
hc as (select count(*) filter (where c = 1) as n1, count(*) filter (where c = 2) as n2, count(*) filter (where c = 3) as n3, count(*) filter (where c = 4) as n4 from pair),
lc as (select count(*) filter (where b = 1) as n1, count(*) filter (where b = 2) as n2, count(*) filter (where b = 3) as n3, count(*) filter (where b = 4) as n4 from word),
h as (select n1 / (n1 + 2 * n2) as y, least(greatest(1 - 2 * y * n2 / n1, 0.05), 0.95) as d1, least(greatest(2 - 3 * y * n3 / n2, 0.05), 1.95) as d2, least(greatest(3 - 4 * y * n4 / n3, 0.05), 2.95) as d3 from hc),
l as (select n1 / (n1 + 2 * n2) as y, least(greatest(1 - 2 * y * n2 / n1, 0.05), 0.95) as d1, least(greatest(2 - 3 * y * n3 / n2, 0.05), 1.95) as d2, least(greatest(3 - 4 * y * n4 / n3, 0.05), 2.95) as d3 from lc),
free as (select (d1 * count(*) filter (where b = 1) + d2 * count(*) filter (where b = 2) + d3 * count(*) filter (where b > 2)) / sum(b) as f from word, l group by d1, d2, d3),
context as (select u, cast(sum(c) as double) as c, count(*) filter (where c = 1) as n1, count(*) filter (where c = 2) as n2, count(*) filter (where c > 2) as n3 from pair group by 1),
scored as (select t.doc_id, coalesce(x.c, 0) as c, (coalesce(x.b, 0) - case when x.b is null then 0 when x.b = 1 then l.d1 when x.b = 2 then l.d2 else l.d3 end) / total.b + free.f / (total.v + 1) as q,
    case when k.u is null then null else (coalesce(p.c, 0) - case when p.c is null then 0 when p.c = 1 then h.d1 when p.c = 2 then h.d2 else h.d3 end) / k.c end as own, (h.d1 * k.n1 + h.d2 * k.n2 + h.d3 * k.n3) / k.c as g
    from token t cross join total cross join h cross join l cross join free left join word x on t.w = x.w left join context k on t.u = k.u left join pair p on t.u = p.u and t.w = p.w),
summed as (select doc_id, count(*) as n_tokens, count(*) filter (where c > 0) as n_known, sum(log10((c + 1) / (n + v + 1))) as base, sum(log10(case when own is null then q else own + g * q end)) as score from scored, total group by 1)
select s.doc_id, i.held_out, n_tokens, n_known, cast(n as bigint) as train_tokens, round(base, 6) as base_score, round(score, 6) as score, round(pow(10, -score / n_tokens), 6) as perplexity from summed s join id i on s.doc_id = i.doc_id cross join total
"""

PHRASES_SQL = rf"""
with doc as (select coalesce(lang, 'und') as lang, {LOWER.format("coalesce(text, '')")} as text from documents),
piece as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from doc),
listed as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from piece),
occurrence as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from listed cross join (select unnest([1, 2, 3]) as size) z where len(w) >= size),
f as (select lang, size, phrase, count(*) as c from occurrence group by all),
total as (select lang, sum(c) as n from f where size = 1 group by 1),
candidate as (select lang, size, phrase, c as a, string_split(phrase, ' ') as w from f where size > 1 and c >= 10),
cut as (select x.*, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest from candidate x cross join (select unnest([1, 2]) as k) z where k < size),
score as (select x.lang, x.size, x.phrase, x.a, x.k, l.c as l, r.c as r, (1000000::hugeint * x.a * x.a) // (l.c::hugeint * r.c) as score from cut x join f l on l.lang = x.lang and l.size = x.k and l.phrase = x.head join f r on r.lang = x.lang and r.size = x.size - x.k and r.phrase = x.rest),
best as (select * from score qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as most from candidate cross join (select unnest([1, 2]) as i) z where size = 3 group by 1, 2),
kept as (select b.* from best b left join inside i on b.size = 2 and b.lang = i.lang and b.phrase = i.phrase where i.most is null or 100 * i.most < 50 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(t.n as bigint) as n, cast(score as bigint) as score from ranked join total t using (lang) where rank <= 2000
"""

_NEAREST = """a{0} as materialized (select rid, k, d from (select rid, k, sum((x - c) * (x - c)) as d from x join c{0} using (i) group by rid, k) qualify row_number() over (partition by rid order by d, k) = 1)"""
_MOVED = """c{1} as materialized (select k, i, coalesce(new, c) as c from c{0} left join (select k, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as new from x join a{0} using (rid) group by k, i) using (k, i))"""
CENTROIDS_SQL = f"""
with kept as materialized (select row_number() over () as rid, vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
x as materialized (select rid, unnest(range(1, 65)) as i, cast(floor(1024 * cast(unnest(embedding) as double)) as bigint) as x from kept),
c0 as materialized (select k, i, x as c from (select rid, row_number() over (order by sha256('3:' || vec_id)) - 1 as k from kept qualify k < 8) join x using (rid)),
{", ".join(_NEAREST.format(r) + ", " + _MOVED.format(r, r + 1) for r in range(10))}, {_NEAREST.format(10)},
digest as (select k, sha256(string_agg(c, ',' order by i)) as sha from c10 group by k)
select vec_id, cast(k as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha as centroid_sha256 from a10 join kept using (rid) join digest using (k)
"""

#: Of those that SQL can express. Media digests, seeded choices, alignments and the classifier can't be; those queries are tested against brute force.
ORACLE: dict[str, str] = {"op2_unit_dedup": UNITS_SQL, "op3_jaccard_join": JACCARD_SQL, "op9_kneser_ney": NGRAM_SQL, "op12_phrase_growth": PHRASES_SQL, "op13_exact_centroids": CENTROIDS_SQL}
