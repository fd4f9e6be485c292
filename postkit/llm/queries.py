"""Registered queries of this subpackage and their SQL twins (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.llm import chat_format, collocations, decontam, embed_dedup, html_text, langid, line_dedup, minhash, packing, token_align, token_counts, toxicity, warc
from postkit.llm.common import fold
from postkit.llm.tokenizer import token_lengths
from postkit.session import literal_frame, materialize, read_table, scratch_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its nearest labelled examples; fold 0 of 5 is not learnt from."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.fit_and_score(docs, labels, fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items (Wu-Manber)."""
    return decontam.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of fold 2 of 4 are not learnt from."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, keep=["doc_id", "held_out"])


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under weighted Jaccard similarity >= 0.8 of five-word shingles."""
    return minhash.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (cosine >= 0.9) and components of all vectors by an epsilon grid order join."""
    return embed_dedup.link_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and truncated totals at every encoded length as a context limit."""
    return token_counts.limit_table(materialize(
        token_counts.length_histogram(token_lengths(read_table(spark, sf_dir, "documents"))), "token-hist"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive, and what the archive then says of it."""
    path = warc.write_archive(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.digest(spark, path).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to_id").toDF(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by tree scoring."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot under the least padding (16 buckets, 65,536 tokens a batch)."""
    return packing.pack(materialize(token_lengths(read_table(spark, sf_dir, "documents")), "lengths"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words of every language."""
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its output then says of it; conversation -1 holds the template's own marks."""
    marks = "</s>[INST] ok [/INST]"
    own = literal_frame(spark, [(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    convs = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_conversations(convs))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap groups of two tokenizers in every document, and how usual its linked token pairs are."""
    return token_align.summarise(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_chat_format": op12_chat_format,
    "op13_token_align": op13_token_align,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op2_decontaminate": rf"""
with doc as (select doc_id, {_WORDS} as w from documents),
item as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
win as (select distinct item, least(len(w), 13) as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as s
        from (select item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from item where len(w) > 0)),
spot as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as s
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
             from doc, (select distinct k from win) where len(w) >= k)),
hit as (select doc_id, spot.k, i, item from spot join win on spot.k = win.k and spot.s = win.s),
pos as (select doc_id, count(distinct p) as n_hit
        from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
ids as (select doc_id, count(distinct item) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct doc_id, item from hit) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join pos on pos.doc_id = doc.doc_id left join ids on ids.doc_id = doc.doc_id
""",
    "op3_line_dedup": r"""
with split as (select doc_id, text, string_split(text, chr(10)) as l from documents),
line as (select doc_id, text, unnest(range(len(l))) as line_no, unnest(l) as line from split),
plain as (select doc_id, text, line_no, trim(regexp_replace(line, '[ \t\f\r\x0B]+', ' ', 'g'), ' ') as p from line),
masked as (select *, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') as m from plain),
normal as (select doc_id, text, line_no, case when len(string_split(m, '<*>')) * 2 - 2 < len(string_split(m, ' ')) then m else p end as s from masked),
leafed as (select *, case when s = '' then 0 else len(string_split(s, ' ')) end as n_tokens, array_to_string(string_split(s, ' ')[1:3], ' ') as lead from normal),
distinct_line as (select distinct n_tokens, lead, s from leafed where n_tokens > 0),
opened as (select * from distinct_line where (n_tokens, lead) in (select (n_tokens, lead) from distinct_line group by all having count(*) > 1)),
token as (select n_tokens, lead, s, unnest(range(n_tokens)) as pos, unnest(string_split(s, ' ')) as token from opened),
vote as (select n_tokens, lead, pos, token, count(*) as n from token group by all),
common as (select n_tokens, lead, pos, first(token order by n desc, token) as token from vote group by n_tokens, lead, pos),
agree as (select t.n_tokens, t.lead, t.s from token t join common c on t.n_tokens = c.n_tokens and t.lead = c.lead and t.pos = c.pos
          group by all having sum(case when t.token = c.token then 1 else 0 end) >= 0.8 * t.n_tokens),
rest as (select t.* from token t left join agree a on a.s = t.s where a.s is null),
support as (select n_tokens, lead, pos, token, count(*) as n from rest group by all),
held as (select r.n_tokens, r.lead, r.s, list({'pos': r.pos, 'token': r.token, 'n': u.n} order by r.pos) as h, list(u.n order by u.n desc) as ns
         from rest r join support u on u.n_tokens = r.n_tokens and u.lead = r.lead and u.pos = r.pos and u.token = r.token group by r.n_tokens, r.lead, r.s),
formed as (select n_tokens, lead, s, array_to_string(list_transform(list_filter(h, lambda x: x.n >= ns[cast(ceil(0.8 * n_tokens) as int)]), lambda x: x.pos || ' ' || x.token), ' ') as form
           from held where ns[cast(ceil(0.8 * n_tokens) as int)] > 1),
family as (select s, 'F' || n_tokens || '|' || lead || '|' || form as f from formed qualify count(*) over (partition by n_tokens, lead, form) > 1),
named as (select l.*, case when l.n_tokens = 0 then null when a.s is not null then 'T' || l.n_tokens || '|' || l.lead else coalesce(m.f, 'L' || l.s) end as template
          from leafed l left join agree a on a.s = l.s left join family m on m.s = l.s),
recurring as (select template, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from named where template is not null group by 1),
first_line as (select n.template, r.first_doc, min(n.line_no) as first_line
               from named n join recurring r on r.template = n.template and r.first_doc = n.doc_id
               where r.n_docs >= 2 group by 1, 2),
mark as (select n.doc_id, n.text, n.line_no, f.template is not null and not (n.doc_id = f.first_doc and n.line_no = f.first_line) as dropped
         from named n left join first_line f on f.template = n.template),
raw as (select m.*, l.line from mark m join line l on l.doc_id = m.doc_id and l.line_no = m.line_no)
select d.doc_id, case when d.text is null then null else coalesce(string_agg(r.line, chr(10) order by r.line_no) filter (not r.dropped), '') end as text,
       count(r.line_no) as n_lines, count(r.line_no) filter (r.dropped) as n_dropped
from documents d left join raw r on r.doc_id = d.doc_id group by d.doc_id, d.text
""",
    "op6_embedding_dedup": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
pair as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select a, b from pair union select reach.a, pair.b from reach join pair on reach.b = pair.a),
links as (select a, count(*) as n from pair group by a),
low as (select a, min(b) as m from reach group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(m, e.vec_id)) as component_id, e.vec_id <= coalesce(m, e.vec_id) as kept
from embeddings e left join links on links.a = e.vec_id left join low on low.a = e.vec_id
""",
    "op9_html_text": r"""
with inside as (select page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<br>', ' ') as h from pages),
block as (select page_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as b
          from (select page_id, regexp_split_to_array(h, '</?(?:p|h1|h2|ul|li)(?:>|\s[^>]*>)') as l from inside)),
clean as (select page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'),
            '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as t from block),
text as (select page_id, string_agg(t, chr(10) || chr(10) order by i) as t from clean where t <> '' group by page_id)
select p.page_id, p.url, coalesce(t, '') as text, cast(length(coalesce(t, '')) as bigint) as n_chars
from pages p left join text on text.page_id = p.page_id
""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as x, min(page_id) over (partition by h) as first_id from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as int), 1)
                        for i in range(32)], '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from d
""",
    "op11_collocations": r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
cut as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
seq as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from cut, (select unnest([1, 2, 3]) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as n from seq group by all),
cand as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 10),
part as (select lang, k, phrase, a, w, unnest(range(1, k)) as c from cand),
scored as (select p.lang, p.phrase, p.a, p.c, x.n as l, y.n as r, (1000000::hugeint * p.a * p.a) // (x.n::hugeint * y.n) as score
           from part p join f x on x.lang = p.lang and x.phrase = array_to_string(p.w[1:p.c], ' ')
                       join f y on y.lang = p.lang and y.phrase = array_to_string(p.w[p.c + 1:p.k], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (select lang, a, array_to_string(w[i:i + 1], ' ') as phrase from (select lang, a, w, unnest([1, 2]) as i from cand where k = 3)),
kept as (select * from best b where not exists (select 1 from inside x where x.lang = b.lang and x.phrase = b.phrase and 100 * x.a >= 50 * b.a)),
total as (select lang, sum(n) as n from f where k = 1 group by lang)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(t.n as bigint) as n, cast(score as bigint) as score
from kept b join total t on t.lang = b.lang qualify rank <= 2000
""",
    "op12_chat_format": r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
escaped as (select *, regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|\[/?TURN\]|\[ROLE\])', '\1\1\\\2', 'g') as e,
                   regexp_replace(role, '(\\*)(</?s>|\[/?INST\]|\[/?TURN\]|\[ROLE\])', '\1\1\\\2', 'g') as named from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(e) + case role when 'user' then 18 when 'assistant' then 6 else 26 + length(named) end) as bigint) as formatted_chars,
       0::bigint as rewritten, true as whole
from escaped group by conv_id
""",
}
