"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.session import work_path

from .bpe import encode_decode
from .centroid_clusters import cluster_vectors
from .collocations import mine_collocations
from .decontaminate import find_leaks
from .golay_dedup import fingerprint_components
from .language_id import fit_dictionaries, identify
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .pii import count_of, find_personal_data, written
from .quality import fit_ratios, judge_quality
from .substring_dedup import dedup_substrings
from .token_files import read_token_files, write_token_files
from .url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_WORDS = f"regexp_extract_all(coalesce(text, ''), '[^ ' || chr(9) || '-' || chr(13) || ']+')"

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]




def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; nothing of it is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query()
def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    dictionaries = fit_dictionaries(docs.where(~F.col("held_out")))
    return identify(docs, dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query()
def op2_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read(spark, sf_dir, "benchmark"))


@query()
def op3_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    judged = judge_quality(docs, fit_ratios(docs, good))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query()
def op4_minhash_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2, percent=80)


@query()
def op5_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op6_pii(spark, sf_dir):
    found = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of("base", kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query(f"""
with parts as (
  select page_id, coalesce({SQL_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         max_by(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from parts left join fits using (page_id)
""")
def op7_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(f"""
with docs as (select doc_id, {SQL_WORDS} as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from docs),
wins as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as win from starts),
firsts as (select win, min(doc_id) as first_doc from wins group by win),
hits as (select doc_id, i from wins join firsts using (win) where first_doc < doc_id),
gone as (select distinct doc_id, i + j as pos from hits, range(13) t(j)),
words as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from docs),
kept as (select w.doc_id, w.pos, w.word, g.pos is not null as removed from words w left join gone g on w.doc_id = g.doc_id and w.pos = g.pos)
select d.doc_id, len(d.words)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(txt, '')) as kept_sha256
from docs d left join (select doc_id, count_if(removed) as n_removed, string_agg(word, ' ' order by pos) filter (where not removed) as txt
                       from kept group by doc_id) k using (doc_id)
""")
def op8_substring_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op9_token_files(spark, sf_dir):
    path = work_path(spark, "token-files")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(docs, path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(f"""
with numbered as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, {SQL_LOWER.format(f"trim(line, {SQL_SPACE})")} as key from numbered),
frequent as (select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (select doc_id, pos, line, f.key is not null and doc_id <> last as dropped
           from keyed left join frequent f on keyed.key = f.key)
select doc_id, count(*)::BIGINT as n_lines, count_if(dropped)::BIGINT as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
""")
def op10_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, report=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({SQL_LOWER.format("coalesce(text, '')")},
         '[.,;:!?' || chr(10) || '-' || chr(13) || ']')) as piece from documents),
worded as (select lang, regexp_extract_all(piece, '[^ ' || chr(9) || ']+') as w from pieces),
grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from worded, range(1, 6) t(m) where len(w) >= m),
counts as (select lang, m, phrase, count(*) as f from grams group by lang, m, phrase),
totals as (select lang, sum(f)::HUGEINT as n from counts where m = 1 group by lang),
cands as (select lang, m, phrase, string_split(phrase, ' ') as w, f as a from counts where m > 1 and f >= 100),
inner_parts as (
  select lang, a, unnest(flatten(list_transform(range(2, m), lambda b: list_transform(range(1, m - b + 2), lambda i: array_to_string(w[i:i + b - 1], ' '))))) as phrase
  from cands where m > 2),
longer as (select lang, phrase, max(a) as longer from inner_parts group by lang, phrase),
cuts as (
  select c.lang, c.phrase, c.a, n, k, x.f as l, y.f as r, 1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f) as score
  from (select *, unnest(range(1, m)) as k from cands) c join totals on totals.lang = c.lang
  join counts x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where coalesce(longer, 0) < a)
select lang, rank::BIGINT as rank, phrase, a::BIGINT as a, l::BIGINT as l, r::BIGINT as r, n::BIGINT as n, score::BIGINT as score from ranked where rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    return mine_collocations(read(spark, sf_dir, "documents").select("text", "lang"))


@query()
def op12_golay_simhash(spark, sf_dir):
    return fingerprint_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def sql_clusters(k: int, rounds: int) -> str:
    """Lloyd's rounds as a chain of tables; inner products of whole numbers this small are exact in doubles."""
    parts = [f"""kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
             f"""c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id)) - 1 as k, v as c from kept qualify k < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (
  select vec_id, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), k := k)) as near
  from kept, c{i} group by vec_id)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (
  select c{i}.k, coalesce(m.c, c{i}.c) as c from c{i} left join (
    select k, list(mean order by p) as c from (
      select near.k as k, p, floor(sum(v[p])::DOUBLE / count(*)) as mean from a{i} join kept using (vec_id), range(1, 65) t(p) group by near.k, p)
    group by k) m on m.k = c{i}.k)""")
    return ("with " + ",\n".join(parts) + f"""
select vec_id, near.k::INTEGER as cluster, near.d::BIGINT as distance, (sum(near.d) over (partition by near.k))::BIGINT as cluster_inertia,
       (sum(near.d) over ())::BIGINT as inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) as centroid_sha256
from a{rounds} join c{rounds} on near.k = c{rounds}.k""")


@query(sql_clusters(40, 5))
def op13_centroid_clusters(spark, sf_dir):
    return cluster_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
