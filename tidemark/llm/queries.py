"""The registered queries of this subpackage: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, collocations, jaccard, language, licenses, line_dedup, mixing, packing, token_counts, token_output, topk, toxicity, whitening
from tidemark.llm.shared import crc_mod, table


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_output.round_trip(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"), rule="start")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_token_output": op5_token_output,
    "op6_token_counts": op6_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
ranked as (
  select source, count(*) as n_rows, sum(size)::bigint as source_size,
         (array[3, 1, 2])[1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] as weight
  from sizes group by source),
levels as (
  select *, 2 * source_size as cap, sum(source_size) over ()::double * 1.5 as total,
         coalesce(sum(2 * source_size) over w, 0)::double as below,
         (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as open_weight
  from ranked
  window w as (order by (2 * source_size)::double / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
fulls as (select *, cap <= weight * ((total - below) / open_weight) as is_full from levels),
targets as (
  select source, source_size,
         case when is_full then cap::double
              else weight * ((total - sum(case when is_full then cap else 0 end) over ()::double)
                   / nullif(sum(case when is_full then 0 else weight end) over (), 0)::double) end as target
  from fulls),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets),
placed as (
  select d.doc_id, d.size, b.source_size, b.target, b.whole,
         floor(b.target)::bigint - b.whole * b.source_size as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sizes d join budgets b on d.source is not distinct from b.source)
select doc_id, size::bigint as size, source_size, target, (whole * size + least(size, greatest(0, budget - before)))::bigint as taken
from placed""",
}


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES["op8_ngram_join"] = op8_ngram_join


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op7_nearest": op7_nearest, "op9_top_k": op9_top_k}
ORACLE_SQL["op9_top_k"] = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, q.v as query, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and (q.vec_id <> c.vec_id or q.v <> c.v)),
ranked as (
  select *, row_number() over (partition by query_id, query order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids whose crc32 leaves 1 modulo 3 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours", "cosines")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ids whose crc32 leaves 2 modulo 4 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES |= {"op1_toxicity": op1_toxicity, "op2_language": op2_language, "op10_licenses": op10_licenses}


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES["op11_collocations"] = op11_collocations
ORACLE_SQL["op11_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
grams as (
  select lang, k as m, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3, 4, 5]) as k from worded))),
counts as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 100),
candidates as (select * from counts where m > 1),
cuts as (
  select c.lang, c.phrase, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[:k], ' ') as lhs, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') as rhs
  from (select *, unnest(range(1, m)) as k from candidates) c),
scored as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, n, ((1000::hugeint * c.a * n) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = lhs join counts y on y.lang = c.lang and y.phrase = rhs join totals t on t.lang = c.lang),
least as (select *, row_number() over (partition by lang, phrase order by score, k) as turn from scored),
kept as (
  select * from least s where turn = 1 and not exists (
    select 1 from candidates c where c.lang = s.lang and c.f >= s.a and len(c.phrase) > len(s.phrase) and contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines that ten documents hold go, the first of them too."""
    clean = line_dedup.drop_lines(table(spark, sf_dir, "documents"), min_docs=10, keep_first=False)
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES["op12_line_dedup"] = op12_line_dedup
ORACLE_SQL["op12_line_dedup"] = """
with docs as materialized (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lined as materialized (
  select r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select r, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line from docs)),
common as (select key from (select distinct r, key from lined where key <> '') group by key having count(*) >= 10),
kept as (select r, count(*) as n, string_agg(line, chr(10) order by i) as text from lined anti join common using (key) group by r)
select doc_id, len(lines)::bigint as n_lines, (len(lines) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (r)"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))


QUERIES["op13_whitening"] = op13_whitening
