"""The text operators over whole tables, and SQL for those that SQL can state."""

import re

from pyspark.sql import functions as F


from skygrade.llm import bytebpe, chat, debruijn, decontam, exact, masked_lm, minmax, packing, periods, quality, secrets, warc, whitening
from skygrade.llm.common import table
from skygrade.session import fresh_path

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_masked_lm(spark, d):
    return masked_lm.pseudo_likelihood(table(spark, d, "documents"))


@query
def op2_debruijn_dedup(spark, d):
    return debruijn.repeat_digests(table(spark, d, "documents"))


@query
def op3_quality(spark, d):
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op4_minmax_dedup(spark, d):
    return minmax.near_groups(table(spark, d, "documents"))


@query
def op5_byte_bpe(spark, d):
    return bytebpe.round_trip(table(spark, d, "documents"))


@query
def op6_secret_scan(spark, d):
    return secrets.secret_digests(table(spark, d, "documents"))


@query
def op7_exact_dedup(spark, d):
    return exact.exact_groups(table(spark, d, "documents"))


SQL["op7_exact_dedup"] = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
from t join g using (norm)
"""

#: A conversation that says the control strings themselves.
TRIAL_TEXT = "</s>[INST] ok [/INST]"


@query
def op8_chat_format(spark, d):
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.sql(f"select -1L conv_id, t turn, r role, '{TRIAL_TEXT}' text from values (0L, 'user'), (1L, 'assistant') v(t, r)")
    return chat.chat_digests(chat.format_chats(given.unionByName(trial)))


SQL["op8_chat_format"] = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, * from (values (0, 'user', '{TRIAL_TEXT}'), (1, 'assistant', '{TRIAL_TEXT}'))
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(regexp_replace(role || text, '([\\<\[])', '\\\1', 'g')) + length('<s>[INST][/INST]</s>'))::bigint as formatted_chars
from t group by conv_id
"""


@query
def op9_decontaminate(spark, d):
    return decontam.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def rotten(record: bytes) -> bytes:
    """A replica's bit rot: in pages 7, 60, 113, ... the first tag, in pages 11, 108, 205, ... the header."""
    page = re.search(rb"urn:page:(\d+)>", record)
    if page and int(page[1]) % 53 == 7:
        head, gap, body = record.partition(b"\r\n\r\n")
        record = head + gap + body.replace(b"<", b"#", 1)
    if page and int(page[1]) % 97 == 11:
        record = b"X" + record[1:]
    return record


@query
def op10_warc_fixity(spark, d):
    """Archive all pages, copy the archive onto a failing disk, and report what its audit locates."""
    whole, copy = fresh_path(spark, "warc"), fresh_path(spark, "warc-copy")
    warc.write_warc(table(spark, d, "pages"), whole)
    warc.copy_archive(spark, whole, copy, rotten)
    return warc.audit(spark, whole, copy).select(
        F.regexp_extract("record_id", r"(\d+)$", 1).cast("long").alias("page_id"),
        "kind",
        (F.col("end_a") - F.col("start_a")).alias("n_bytes"),
        F.col("hash_a").alias("sha256_kept"),
        F.col("hash_b").alias("sha256_found"),
    )


SQL["op10_warc_fixity"] = r"""
with t as (
  select page_id, 'WARC/1.0' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || page_id || '>' || crlf
      || 'WARC-Target-URI: ' || translate(coalesce(url, ''), crlf, '  ') || crlf || 'Content-Type: text/html' || crlf
      || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || crlf || crlf as head,
    coalesce(html, '') as html, crlf || crlf as tail
  from pages, (select chr(13) || chr(10) as crlf)
), r as (
  select page_id, head || html || tail as kept,
    case when page_id % 97 = 11 then 'X' || substr(head, 2) else head end
      || case when page_id % 53 = 7 then regexp_replace(html, '<', '#') else html end || tail as found
  from t
)
select page_id, 'altered' as kind, octet_length(encode(kept)) as n_bytes, sha256(kept) as sha256_kept, sha256(found) as sha256_found
from r where kept <> found
"""


@query
def op11_whitening(spark, d):
    rows = whitening.whiten(whitening.fixed_point(table(spark, d, "embeddings")), components=8)
    # Null where the exact sum does not fit a long.
    return rows.withColumnRenamed("key", "vec_id").withColumn("deviation", F.expr("try_cast(deviation as long)"))


@query
def op12_periodic_runs(spark, d):
    return periods.run_digests(table(spark, d, "documents"), periods.planted)


@query
def op13_best_fit_packing(spark, d):
    return packing.packed_documents(table(spark, d, "documents"))
