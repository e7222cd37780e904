"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

DIM = 64
CELLS, PROBES = 16, 4
NEAR = 1.2


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INTEGER + 1, 1)"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || {variant} || "
        f"substr({h},18,3) || '-' || substr({h},21,12))"
    )


def _int_id(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    first = f"substr('0123456701234567', ('0x' || substr({h}, 1, 1))::INTEGER + 1, 1)"
    return f"('0x' || {first} || substr({h},2,11) || '5' || substr({h},14,3))::BIGINT"


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower({text})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


LABELLED = "(select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))"


def _metadata(r: str = "") -> str:
    """The JSON text of the document metadata, missing keys left out."""
    return (
        f"('{{\"lang\":\"' || {r}lang || '\",\"source\":\"' || {r}source || '\",\"n_chars\":' || {r}n_chars || "
        f"coalesce(',\"quality\":' || {r}quality, '') || coalesce(',\"toxic\":' || {r}toxic, '') || '}}')"
    )


def _hashed(name: str, source: str) -> str:
    """CTEs that turn (key, text) rows of `source` into (key, embedding)."""
    return f"""
{name}_slot as (
  select key, md5(term) as h from (select key, unnest({_tokens('text')}) as term from {source})),
{name}_sum as (
  select key, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} as b,
         sum(1.0 - 2.0 * (('0x' || substr(h, 9, 1))::INTEGER & 1)) as v
  from {name}_slot group by all),
{name}_norm as (select key, sqrt(sum(v * v)) as n from {name}_sum group by key),
{name}_vec as (
  select s.key, list(coalesce(case when n.n > 0 then x.v / n.n end, 0.0)::FLOAT order by r.b) as embedding
  from {source} s cross join (select unnest(range({DIM})) as b) r
  left join {name}_sum x on x.key = s.key and x.b = r.b
  left join {name}_norm n on n.key = s.key
  group by s.key)"""


def _bm25(docs: str, queries: str, mode: str = "and", scope: str = "global", extra: str = "") -> str:
    """CTEs up to `bm25(q_id, collection_id, id, bm25)`."""
    per = "'*'" if scope == "global" else "collection_id"
    need = "where m = n_phrases" if mode == "and" else ""
    return f"""
toks as (select collection_id, id, {_tokens('text')} as tokens from {docs}),
post as (
  select collection_id, id, term, count(*) as tf, any_value(dl) as dl
  from (select collection_id, id, len(tokens) as dl, unnest(tokens) as term from toks) group by collection_id, id, term),
stats as (select {per} as scope, count(*) as n, sum(len(tokens)) / count(*) as avg_dl from toks group by 1),
held as (select {per} as scope, term, count(*) as df from post group by 1, 2),
asked as (
  select q_id, collection_id, term, count(*) as times
  from (select q_id, collection_id, unnest({_tokens('query_text')}) as term from {queries}) group by all),
sizes as (select q_id, count(*) as n_phrases from asked group by q_id),
pairs as (
  select a.q_id, p.collection_id, p.id, count(*) as m,
         list_sum(list(a.times * (greatest(ln((s.n - h.df + 0.5) / (h.df + 0.5)), 1e-6) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avg_dl))) order by a.term)) as bm25
  from asked a join post p on p.collection_id = a.collection_id and p.term = a.term
  join held h on h.term = p.term and h.scope = {per.replace('collection_id', 'p.collection_id')}
  join stats s on s.scope = h.scope {extra}
  group by 1, 2, 3),
bm25 as (
  select q_id, collection_id, id, bm25 from pairs join sizes using (q_id) {need})"""


def _best(source: str, order: str, limit: int, cols: str) -> str:
    return (
        f"select {cols}, rank from (select *, row_number() over (partition by q_id order by {order})::INTEGER as rank "
        f"from {source}) where rank <= {limit}"
    )


def _knn(docs: str, queries: str, k: int, where: str = "") -> str:
    return f"""
dist as (
  select q.q_id, d.collection_id, d.id, {_distance('q.embedding', 'd.embedding')} as distance
  from {queries} q join {docs} d on d.collection_id = q.collection_id {where}),
vec as ({_best('dist', 'distance, id', k, 'q_id, collection_id, id, distance')})"""


VECTORS = "vectors as (select 'all' as collection_id, vec_id::VARCHAR as id, embedding, label from embeddings)"
ASKING = "asking as (select collection_id, id as q_id, embedding from vectors)"
DOCS = f"docs as (select 'docs' as collection_id, doc_id::VARCHAR as id, doc_id::VARCHAR as key, text, lang, source, n_chars, quality, toxic, {_metadata()} as metadata from {LABELLED})"
DOCS_BY = f"docs as (select {{}} as collection_id, doc_id::VARCHAR as id, doc_id::VARCHAR as key, text, lang, source, n_chars, quality, toxic from {LABELLED})"
ITEMS = "items as (select item_id::VARCHAR as key, text from benchmark)"
QUESTIONS = "questions as (select key as q_id, 'docs' as collection_id, text as query_text, embedding from items join q_vec using (key))"
EMBEDDED = "embedded as (select docs.*, embedding from docs join d_vec using (key))"
# All documents under the name docs, with their vectors, and the benchmark texts that ask.
PAIRED = ",\n".join([DOCS.replace("docs as", "raw_docs as", 1), ITEMS, _hashed("d", "raw_docs"), _hashed("q", "items"), "docs as (select raw_docs.*, embedding from raw_docs join d_vec using (key))"])
PAIRED_ASK = "asking as (select 'docs' as collection_id, key as q_id, embedding from items join q_vec using (key))"
FUSED = """
legs as (
  select q_id, collection_id, id, rank as vec_rank, null::INTEGER as kw_rank from vec
  union all select q_id, collection_id, id, null, rank from kw),
fused as (
  select q_id, collection_id, id, min(vec_rank) as vec_rank, min(kw_rank) as kw_rank,
         case when min(vec_rank) is null then 'keyword' when min(kw_rank) is null then 'vector' else 'both' end as source,
         coalesce(1.0::DOUBLE / (60 + min(vec_rank)), 0.0) + coalesce(1.0::DOUBLE / (60 + min(kw_rank)), 0.0) as score
  from legs group by 1, 2, 3)"""
FUSED_ORDER = "score desc, vec_rank asc nulls last, kw_rank asc nulls last, id"


def _search_ctes(mode: str, k_vec: int, k_kw: int, k: int, by: str | None = None, allowed: str = "true") -> str:
    """CTEs of a hybrid search up to `top`."""
    if by is None:
        asked = QUESTIONS
        docs = DOCS
    else:
        docs = DOCS_BY.format(by)
        asked = (
            f"homes as (select distinct {by} as collection_id from documents), "
            "questions as (select h.collection_id || ':' || key as q_id, h.collection_id, text as query_text, embedding "
            "from items join q_vec using (key), homes h)"
        )
    parts = [
        docs,
        ITEMS,
        _hashed("d", "docs"),
        _hashed("q", "items"),
        asked,
        EMBEDDED,
        f"open as (select * from embedded where {allowed})",
        _knn("open", "questions", k_vec),
        _bm25("docs", "questions", mode),
        "matched as (select b.* from bm25 b join open o on o.collection_id = b.collection_id and o.id = b.id)",
        f"kw as ({_best('matched', 'bm25 desc, id', k_kw, 'q_id, collection_id, id, bm25')})",
        FUSED,
        f"top as ({_best('fused', FUSED_ORDER, k, 'q_id, collection_id, id, score, source')})",
    ]
    return "with " + ",\n".join(parts)


def _renumbered(where: str, cols: str) -> str:
    return (
        f"select q_id, row_number() over (partition by q_id order by rank)::INTEGER as rank, {cols} "
        f"from (select t.q_id, t.rank, t.score, t.source as leg, d.* from top t join docs d using (collection_id, id)) where {where}"
    )


ANN = f"""
pivots as (
  select row_number() over (order by md5(id), id) as p, embedding
  from (select * from vectors order by md5(id), id limit {CELLS})),
near as (
  select v.id, p.p, row_number() over (
    partition by v.id order by {_distance('v.embedding', 'p.embedding')}, p.p) as pr
  from vectors v cross join pivots p),
cand as (
  select n.id as q_id, c.id from near n join near c on c.p = n.p and c.pr = 1 where n.pr <= {PROBES}),
dist as (
  select c.q_id, c.id, {_distance('a.embedding', 'b.embedding')} as distance
  from cand c join vectors a on a.id = c.q_id join vectors b on b.id = c.id),
ann as ({_best('dist', 'distance, id', 5, 'q_id, id, distance')})"""

ARRIVALS = f"""
hits as (
  select distinct n.vec_id as id from embeddings n join embeddings s
    on n.label >= 7 and s.label < 7 and {_distance('n.embedding', 's.embedding')} <= {NEAR})"""

HYBRID_WHERE = "lang in ('en', 'fr') and n_chars > 300"


def _part(where: str) -> str:
    return f"select p_partkey, p_brand, p_type, p_size, p_retailprice from part where {where}"


def _lab(where: str) -> str:
    return f"select doc_id, lang, quality, toxic, n_chars from {LABELLED} where {where}"


def _ids(where: str) -> str:
    return f"select doc_id::VARCHAR as id from {LABELLED} where {where}"


def _pieces(text: str, sep: str) -> str:
    blank = r"\s\x0B"
    return (
        f"list_filter(list_transform(string_split({text}, {sep}), "
        f"lambda p: regexp_replace(p, '^[{blank}]+|[{blank}]+$', '', 'g')), lambda p: length(p) > 50)"
    )


def _chunks(source: str, cols: str, text: str) -> str:
    return f"""
chunked as (
  select {cols}, case when len({_pieces(text, "chr(10) || chr(10)")}) > 0 then {_pieces(text, "chr(10) || chr(10)")}
                 else {_pieces(text, "chr(10)")} end as pieces
  from {source}),
chunks as (
  select {cols}, unnest(range(len(pieces)))::INTEGER as chunk, unnest(pieces) as text from chunked)"""


SPANS = r"""
found as (
  select id, list_filter(regexp_extract_all('. ' || text,
    '[.!?\n]\s*\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*|\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*'),
    lambda m: not (regexp_matches(m, '^[.!?\n]') and not contains(regexp_replace(m, '^[.!?\s]+', ''), ' '))) as ms
  from SOURCE),
mentions as (
  select id, unnest(range(len(ms)))::INTEGER as pos, regexp_replace(unnest(ms), '^[.!?\s]+', '') as text from found),
uniq as (select id, text, min(pos) as first, max(pos) as last from mentions group by id, text),
pairs as (
  select a.text as subject, 'related_to' as predicate, b.text as object, a.id as document_id, 0.8::DOUBLE as weight
  from uniq a join uniq b on a.id = b.id and a.first < b.first)"""
ALL_TEXTS = "texts as (select doc_id::VARCHAR as id, text from documents)"

TRIPLES = """
edges as (
  select 'customer:' || c_custkey as subject, 'in_nation' as predicate, 'nation:' || c_nationkey as object from customer
  union all select 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey from supplier
  union all select 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey from nation
  union all select 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey from orders
  union all select distinct 'order:' || l_orderkey, 'contains', 'part:' || l_partkey from lineitem)"""

DOC_LOG = f"""
log as (
  select doc_id::VARCHAR as id, 1 as batch, 'upsert' as op, text from documents
  union all select d.doc_id::VARCHAR, 2, 'upsert', 'v2 ' || text from documents d join labels l using (doc_id)
  union all select doc_id::VARCHAR, 3, 'delete', null from labels where toxic = 1),
last as (select id, max(batch) as batch, arg_max(op, batch) as op, arg_max(text, batch) as text from log group by id)"""


def _ingest() -> str:
    return ",\n".join(
        [
            f"docs as (select doc_id::VARCHAR as id, doc_id::VARCHAR as key, text, quality from {LABELLED})",
            _hashed("d", "docs"),
            "full_docs as (select docs.*, embedding from docs join d_vec using (key))",
            f"""dups as (
  select distinct n.id from full_docs n join full_docs s on n.quality is null and s.quality is not null
    and {_distance('n.embedding', 's.embedding')} <= 0.1)""",
            "kept as (select * from docs where quality is null and id not in (select id from dups))",
        ]
    )


ORACLE = {
    "vector_topk_exact": f"with {VECTORS}, {ASKING}, {_knn('vectors', 'asking', 5)} select q_id, rank, id, round(distance, 6) as distance from vec",
    "vector_topk_isolated": (
        "with vectors as (select label::VARCHAR as collection_id, vec_id::VARCHAR as id, embedding from embeddings), "
        f"{ASKING}, {_knn('vectors', 'asking', 5)} select q_id, collection_id, rank, id, round(distance, 6) as distance from vec"
    ),
    "vector_topk_approximate": f"with {VECTORS}, {ANN} select q_id, rank, id, round(distance, 6) as distance from ann",
    "vector_ann_recall": (
        "with vectors as (select 'all' as collection_id, vec_id::VARCHAR as id, embedding from embeddings), "
        f"{ANN}, pair_dist as (select a.id as q_id, b.id, {_distance('a.embedding', 'b.embedding')} as distance "
        f"from vectors a, vectors b), vec as ({_best('pair_dist', 'distance, id', 5, 'q_id, id')}) "
        "select count(*) as n_exact, count(ann.id) as n_found from vec left join ann using (q_id, id)"
    ),
    "vector_distance_to_class": (
        "with first as (select label, arg_min(embedding, vec_id) as f from embeddings group by label) "
        f"select vec_id::VARCHAR as id, round({_distance('embedding', 'f')}, 6) as distance from embeddings join first using (label)"
    ),
    "vector_search_filtered": (
        f"with {PAIRED}, {PAIRED_ASK}, {_knn('docs', 'asking', 10)}, kept as (select q_id, id, distance, length(text) as chars, "
        "row_number() over (partition by q_id order by rank)::INTEGER as rank from vec join docs using (collection_id, id) "
        "where lang = 'en' and toxic = 0) select q_id, rank, id, round(distance, 6) as score, chars::INTEGER as chars from kept where rank <= 5"
    ),
    "vector_search_operators": (
        f"with {PAIRED}, {PAIRED_ASK}, {_knn('docs', 'asking', 10)}, kept as (select q_id, id, distance, "
        "row_number() over (partition by q_id order by rank)::INTEGER as rank from vec join docs using (collection_id, id) "
        "where n_chars >= 1000 and quality is distinct from 1) select q_id, rank, id, round(distance, 6) as score from kept where rank <= 5"
    ),
    "where_eq": _part("p_brand = 'Brand#13'"),
    "where_eq_null": _lab("quality is null"),
    "where_ne": _lab("quality is distinct from 1"),
    "where_gt": _part("p_retailprice > 915"),
    "where_gte": _part("p_size >= 25"),
    "where_lt": _part("p_size < 10.5"),
    "where_lte": _lab("n_chars <= 500"),
    "where_in": _part("p_type in ('ECONOMY', 'SMALL')"),
    "where_nin": _lab("quality is null or quality not in (1)"),
    "where_and": _part("p_type = 'ECONOMY' and p_size < 20"),
    "where_or": _lab("lang = 'fr' or toxic = 1"),
    "where_nested": _part("(p_type = 'SMALL' and p_size > 20 and p_size <= 40) or p_brand in ('Brand#1', 'Brand#2')"),
    "where_range": _part("p_retailprice >= 901.5 and p_retailprice < 910.25 and p_size is distinct from 7"),
    "where_unknown_op": _part("p_brand = 'Brand#13'"),
    "where_eq_operator": _part("p_brand = 'Brand#13'"),
    "where_json_eq": _ids("lang = 'de' and quality = 1"),
    "where_json_ne": _ids("quality is distinct from 1"),
    "where_json_range": _ids("n_chars > 500 and n_chars <= 2000"),
    "where_json_membership": _ids("source in ('src1', 'src2') and toxic is not null and toxic <> 1"),
    "where_json_nested": _ids("(lang = 'en' and quality = 0) or toxic = 1"),
    "where_json_events": (
        "select event_id, user_id, event_type, props from events "
        "where (props::JSON ->> 'k')::BIGINT >= 50 and (props::JSON ->> 'k')::BIGINT not in (60, 70)"
    ),
    "where_ids": f"select lang as collection_id, doc_id::VARCHAR as id from {LABELLED} where source = 'src3' and quality = 1",
    "metadata_roundtrip": (
        f"select doc_id::VARCHAR as id, '{{\"doc\":\"' || doc_id || '\"}}' as encoded, source, quality from {LABELLED}"
    ),
    "tokenize_terms": (
        f"with toks as materialized (select lang as collection_id, doc_id::VARCHAR as id, {_tokens('text')} as tokens from documents) "
        "select collection_id, id, term, count(*) as tf, any_value(dl) as dl from (select collection_id, id, "
        "len(tokens)::INTEGER as dl, unnest(tokens) as term from toks) group by 1, 2, 3"
    ),
    "postings_refreshed": (
        "with texts as (select lang, doc_id, case when lang = 'fr' then text || ' Été refreshed' else text end as text "
        f"from documents where lang <> 'es'), post as (select lang, doc_id, term, count(*) as tf from (select lang, doc_id, "
        f"unnest({_tokens('text')}) as term from texts) group by all) "
        "select lang as collection_id, term, count(*) as df, sum(tf)::BIGINT as tf from post group by 1, 2"
    ),
    "corpus_statistics": (
        f"with l as (select lang, len({_tokens('text')}) as dl from documents) "
        "select '*' as scope, count(*) as n_docs, round(sum(dl) / count(*), 6) as avg_dl from l "
        "union all select lang, count(*), round(sum(dl) / count(*), 6) from l group by lang"
    ),
    "term_statistics": (
        f"select '*' as scope, term, count(distinct doc_id) as df from (select doc_id, unnest({_tokens('text')}) as term "
        "from documents) group by term"
    ),
}


def _keyword_oracle(mode: str, extra: str = "", ban: str = "") -> str:
    return (
        f"with {DOCS}, questions as (select item_id::VARCHAR as q_id, 'docs' as collection_id, text as query_text from benchmark), "
        f"{_bm25('docs', 'questions', mode)}, open as (select * from bm25 {ban}), "
        f"kw as ({_best('open', 'bm25 desc, id', 10, 'q_id, id, bm25')}) select q_id, rank, id, round(bm25, 6) as bm25 from kw"
    )


_LEGS = (
    "with "
    + ",\n".join(
        [
            DOCS,
            ITEMS,
            _hashed("d", "docs"),
            _hashed("q", "items"),
            QUESTIONS,
            EMBEDDED,
            _knn("embedded", "questions", 10),
            _bm25("docs", "questions", "or"),
            f"kw as ({_best('bm25', 'bm25 desc, id', 20, 'q_id, collection_id, id, bm25')})",
            FUSED,
        ]
    )
    + " "
)

_PREFIX = f"""with {DOCS},
toks as (select id, {_tokens('text')} as tokens from docs),
post as (select id, term, count(*) as tf, any_value(dl) as dl
  from (select id, len(tokens) as dl, unnest(tokens) as term from toks) group by id, term),
stats as (select count(*) as n, sum(len(tokens)) / count(*) as avg_dl from toks),
words as (select item_id::VARCHAR as q_id, {_tokens('text')} as ws from benchmark),
asked as (
  select q_id, phrase, is_prefix, count(*) as times
  from (select q_id, unnest(ws) as phrase, unnest(range(len(ws))) = len(ws) - 1 as is_prefix from words) group by all),
phrases as (select distinct phrase, is_prefix from asked),
hits as (
  select p.id, f.phrase, f.is_prefix, sum(p.tf) as tf, any_value(p.dl) as dl
  from phrases f join post p on not f.is_prefix and p.term = f.phrase group by 1, 2, 3
  union all
  select p.id, f.phrase, f.is_prefix, sum(p.tf), any_value(p.dl)
  from phrases f join post p on f.is_prefix and starts_with(p.term, f.phrase) group by 1, 2, 3),
held as (select phrase, is_prefix, count(*) as df from hits group by 1, 2),
bm25 as (
  select a.q_id, h.id, list_sum(list(a.times * (greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) order by phrase, is_prefix)) as bm25
  from asked a join hits h using (phrase, is_prefix) join held using (phrase, is_prefix), stats group by 1, 2),
kw as ({_best('bm25', 'bm25 desc, id', 10, 'q_id, id, bm25')})
select q_id, rank, id, round(bm25, 6) as bm25 from kw"""

_PER_COLLECTION = (
    f"with {DOCS_BY.format('lang')}, homes as (select unnest(['de', 'en', 'es', 'fr']) as collection_id), "
    "questions as (select collection_id || ':' || item_id as q_id, collection_id, text as query_text from benchmark, homes), "
    f"{_bm25('docs', 'questions', 'or', 'collection')}, kw as ({_best('bm25', 'bm25 desc, id', 10, 'q_id, id, bm25')}) "
    "select q_id, rank, id, round(bm25, 6) as bm25 from kw"
)

_ANSWER = f"with {PAIRED}, {PAIRED_ASK}, {_knn('docs', 'asking', 3)}, ans as (select * from vec join docs using (collection_id, id)) "

ORACLE |= {
    "keyword_bm25": _keyword_oracle("and"),
    "keyword_any": _keyword_oracle("or"),
    "keyword_any_excluding": _keyword_oracle("or", ban="where id not in (select id from post where term = 'license')"),
    "keyword_prefix": _PREFIX,
    "keyword_per_collection": _PER_COLLECTION,
    "rrf_fusion": _LEGS + "select q_id, id, vec_rank, kw_rank, source, round(score, 10) as score from fused",
    "rrf_topk": _LEGS
    + f", top as ({_best('fused', FUSED_ORDER, 10, 'q_id, id, score')}) select q_id, rank, id, round(score, 10) as score from top",
    "keyword_hits_only": _LEGS + "select k.q_id, k.id, k.rank from kw k anti join vec v on v.q_id = k.q_id and v.id = k.id",
    "hybrid_search_all": _search_ctes("and", 10, 20, 10)
    + " "
    + _renumbered("true", "id, round(score, 10) as score, leg as source, length(text)::INTEGER as chars"),
    "hybrid_search_filtered": _search_ctes("or", 20, 20, 10) + " " + _renumbered(HYBRID_WHERE, "id, round(score, 10) as score"),
    "hybrid_search_prefilter": _search_ctes("or", 10, 20, 10, allowed=HYBRID_WHERE)
    + " "
    + _renumbered("true", "id, round(score, 10) as score"),
    "hybrid_search_isolated": _search_ctes("and", 5, 10, 5, by="lang") + " " + _renumbered("true", "id, round(score, 10) as score"),
    "result_lists": (
        f"with {PAIRED}, {PAIRED_ASK}, {_knn('docs', 'asking', 6)}, kept as (select v.*, d.text, row_number() over "
        "(partition by q_id order by rank) as r from vec v join docs d using (collection_id, id) where lang = 'de'), "
        "lists as (select q_id, string_agg(id, ',' order by r) as ids, string_agg(md5(text), ',' order by r) as documents, "
        "count(*)::INTEGER as n_metadatas, string_agg(printf('%.4f', distance), ',' order by r) as distances "
        "from kept where r <= 3 group by q_id) select q_id, coalesce(ids, '') as ids, coalesce(documents, '') as documents, "
        "coalesce(n_metadatas, 0) as n_metadatas, coalesce(distances, '') as distances from asking left join lists using (q_id)"
    ),
    "result_text": _ANSWER
    + "select q_id, md5(string_agg('--- Result ' || rank || ' (Score: ' || printf('%.4f', distance) || ') ---' || chr(10) || text "
    "|| chr(10) || 'Metadata: ' || metadata, chr(10) || chr(10) order by rank)) as rendered from ans group by q_id",
    "result_context": _ANSWER
    + "select q_id, md5(string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) order by rank)) as context "
    "from ans group by q_id",
    "document_int_ids": f"select doc_id::VARCHAR as id, {_int_id('doc_id::VARCHAR')} as int_id from documents",
    "triple_identities": f"with {TRIPLES} select {_uuid5('''('star:' || subject || ':' || predicate || ':' || object)''')} as triple_id, "
    "subject, predicate, object, 1.0::DOUBLE as weight from edges",
    "batch_rows": (
        "select doc_id // 50 as batch, (row_number() over (partition by doc_id // 50 order by doc_id) - 1)::INTEGER as pos, "
        "doc_id::VARCHAR as id, length(text)::INTEGER as chars, '{}' as metadata from documents"
    ),
    "text_files": "select md5(text || chr(10)) as content, (length(text) + 1)::INTEGER as chars, true as named from benchmark",
    "documents_looked_up": f"select lang as collection_id, doc_id::VARCHAR as id, {_metadata()} as metadata from {LABELLED} where toxic = 1",
    "documents_by_label": f"select doc_id::VARCHAR as id, {_int_id('doc_id::VARCHAR')} as int_id from documents where doc_id in (select vec_id from embeddings)",
    "collections_list": (
        f"select {_uuid5('''('["","' || lang || '","1"]')''')} as collection_id, lang as name, '{{\"kind\": \"language\"}}' as metadata "
        "from (select distinct lang from documents)"
    ),
    "collections_get_or_create": (
        f"select {_uuid5('''('["","' || lang || '","1"]')''')} as collection_id, lang as name, '{{\"kind\": \"language\"}}' as metadata "
        "from (select distinct lang from documents) union all "
        f"select {_uuid5('''('["","' || source || '","2"]')''')}, source, '{{\"kind\": \"new\"}}' from (select distinct source from documents)"
    ),
    "collection_counts": "select lang as collection_id, count(*) as n_docs from documents group by lang",
    "collection_deleted": "select doc_id, lang from documents where lang not in ('fr', 'es')",
    "upsert_latest": (
        "select user_id, event_type, event_id, value, props from (select *, row_number() over "
        "(partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1"
    ),
    "documents_latest": f"with {DOC_LOG} select id, {_int_id('id')} as int_id, substr(text, 1, 2) as start, length(text)::INTEGER as chars "
    "from last where op = 'upsert'",
    "versions_replaced": f"with {DOC_LOG} select log.id, log.batch::BIGINT as batch from log join last using (id) "
    "where log.batch < last.batch or last.op = 'delete'",
    "near_duplicates_kept": f"with {ARRIVALS} select vec_id::VARCHAR as id, label from embeddings where label >= 7 and vec_id not in (select id from hits)",
    "near_duplicates_skipped": f"with {ARRIVALS} select vec_id::VARCHAR as id, label from embeddings where vec_id in (select id from hits)",
    "near_duplicates_partitioned": f"with {ARRIVALS} select vec_id::VARCHAR as id, label from embeddings where vec_id in (select id from hits)",
    "ingest_counts": f"with {ARRIVALS} select 'all' as collection_id, count(*) filter (vec_id not in (select id from hits)) as count, "
    "count(*) filter (vec_id in (select id from hits)) as skipped from embeddings where label >= 7",
    "ingest_documents": f"with {_ingest()}, {SPANS.replace('SOURCE', 'kept')} "
    "select (select count(*) from kept) as count, (select count(*) from docs where quality is null) - (select count(*) from kept) as skipped, "
    "(select count(*) from pairs) as triples_extracted",
    "ingest_stored": f"with {_ingest()}, live as (select id, text from docs where quality is not null union all select id, text from kept) "
    f"select id, {_int_id('id')} as int_id, length(text)::INTEGER as chars, {DIM}::INTEGER as dim from live",
    "embed_text": f"with {DOCS}, {_hashed('d', 'docs')} select key as id, unnest(range({DIM}))::INTEGER as at, "
    "round(unnest(embedding)::DOUBLE, 6) as value from d_vec",
    "chunk_documents": f"with {_chunks('documents', 'doc_id', 'text')} select doc_id, chunk, text from chunks",
    "chunk_conversations": "with turns as (select conv_id, turn, role || chr(10) || chr(10) || text || chr(10) || chr(10) || text as text "
    f"from conversations), {_chunks('turns', 'conv_id, turn', 'text')} select conv_id, turn, chunk, text from chunks",
    "chunk_batch": f"with files as (select 'doc' || doc_id || '.txt' as source, text from documents), {_chunks('files', 'source', 'text')} "
    f"select {_uuid5('''(source || '#' || chunk)''')} as id, chunk as pos, md5(text) as text, "
    "'{\"source\":\"' || source || '\",\"chunk\":' || chunk || '}' as metadata from chunks",
    "ingest_text_files": f"with files as (select 'doc' || doc_id || '.txt' as source, text from documents), {_chunks('files', 'source', 'text')}, "
    "pieces as (select source || '#' || chunk as id, text from chunks), "
    f"{SPANS.replace('SOURCE', 'pieces')} select (select count(*) from pieces) as count, 0::BIGINT as skipped, (select count(*) from pairs) as triples_extracted",
    "entity_mentions": f"with {ALL_TEXTS}, {SPANS.replace('SOURCE', 'texts')} select id, pos, text, 'Concept' as label from mentions",
    "entity_unique": f"with {ALL_TEXTS}, {SPANS.replace('SOURCE', 'texts')} select id, first as pos, text, "
    "case when last % 2 = 0 then 'Person' else 'Concept' end as label from uniq",
    "entity_gazetteer": f"""with {ALL_TEXTS}, {SPANS.replace('SOURCE', 'texts')},
names as (select name, row_number() over () as name_id from (select distinct {_tokens('text')} as name from mentions) where len(name) >= 2),
spelled as (select name_id, len(name) as n, unnest(range(len(name))) as k, unnest(name) as w from names),
words as (select id, unnest(range(len(ws)))::INTEGER as pos, unnest(ws) as w from (select id, {_tokens('text')} as ws from texts)),
leads as (
  select a.id, a.pos, x.name_id, x.n from spelled x join spelled y on x.name_id = y.name_id and x.k = 0 and y.k = 1
  join words a on a.w = x.w join words b on b.id = a.id and b.pos = a.pos + 1 and b.w = y.w),
hits as (
  select l.id, l.pos, l.name_id from leads l join spelled s using (name_id)
  join words t on t.id = l.id and t.pos = l.pos + s.k and t.w = s.w group by l.id, l.pos, l.name_id, l.n having count(*) = l.n)
select id, pos, array_to_string(name, ' ') as text, 'Organization' as label from hits join names using (name_id)""",
    "entity_pairs": f"with {ALL_TEXTS}, {SPANS.replace('SOURCE', 'texts')} select * from pairs",
    "triples_upserted": f"""with log as (
  select 'part:' || l_partkey as subject, 'supplier:' || l_suppkey as object, l_orderkey || '-' || l_linenumber as document_id,
         l_quantity as weight, l_orderkey * 100 + l_linenumber as seq from lineitem),
last as (select *, row_number() over (partition by subject, object order by seq desc, document_id desc, weight desc) as r from log)
select {_uuid5('''('star:' || subject || ':sold_by:' || object)''')} as triple_id, subject, object, document_id, weight from last where r = 1""",
    "graph_neighbours": f"with {TRIPLES} select n_name as q_id, subject, predicate, object, 1.0::DOUBLE as weight from edges "
    "join nation on subject = 'nation:' || n_nationkey or object = 'nation:' || n_nationkey",
    "graph_both_ends": f"with {TRIPLES}, names as (select 'nation:' || n_nationkey as e from nation union all select 'region:' || r_regionkey from region) "
    "select subject, predicate, object from edges where subject in (select e from names) or object in (select e from names)",
    "graph_expanded": f"""with {TRIPLES},
ends as (select *, subject as e from edges union all select *, object from edges),
n0 as (select r_name as q_id, 'region:' || r_regionkey as e from region),
t1 as (select distinct q_id, subject, predicate, object from n0 join ends using (e)),
n1 as (select q_id, subject as e from t1 union select q_id, object from t1),
t2 as (select distinct q_id, subject, predicate, object from n1 join ends using (e)),
n2 as (select q_id, subject as e from t2 union select q_id, object from t2),
t3 as (select distinct q_id, subject, predicate, object from n2 join ends using (e))
select q_id, min(hop)::INTEGER as hop, subject, predicate, object from (
  select *, 1 as hop from t1 union all select *, 2 from t2 union all select *, 3 from t3) group by q_id, subject, predicate, object""",
    "graph_text": f"""with {TRIPLES}, hub as (select r_name as q_id, 'region:' || r_regionkey as entity from region)
select q_id, entity, 0::INTEGER as part, 'Knowledge about ''' || entity || ''':' as line from hub
union all select 'no ' || q_id, 'no ' || entity, 0, 'No knowledge found for ''no ' || entity || '''' from hub
union all select q_id, entity, 1, '- ' || subject || ' ' || predicate || ' ' || object from hub join edges on object = entity""",
    "tenant_listing": f"select {_uuid5('''('["","src1_' || lang || '","1"]')''')} as collection_id, lang as name, '{{}}' as metadata "
    "from (select distinct lang from documents where source = 'src1')",
    "tenant_search": _search_ctes("and", 3, 6, 3, by="source") + " " + _renumbered("true", "id, round(score, 10) as score"),
}


# Stored collections ----------------------------------------------------------

_LIVE = f"{_ingest()}, live as (select id, text, embedding from full_docs where quality is not null or id in (select id from kept))"
_LEFT = "stored as (select 'docs' as collection_id, id, text from live where id not in (select doc_id::VARCHAR from labels where toxic = 1))"
_STORED_KEYWORD = (
    f"with {_LIVE}, {_LEFT}, questions as (select item_id::VARCHAR as q_id, 'docs' as collection_id, text as query_text from benchmark), "
    f"{_bm25('stored', 'questions', 'or')}, kw as ({_best('bm25', 'bm25 desc, id', 10, 'q_id, id, bm25')}) "
    "select q_id, rank, id, round(bm25, 6) as bm25 from kw"
)

ORACLE |= {
    "stored_documents": f"with {_LIVE}, meta as (select doc_id::VARCHAR as id, {_metadata()} as metadata from {LABELLED}) "
    "select id, md5(text) as text, metadata from live join meta using (id)",
    "stored_triples": f"with {_ingest()}, {SPANS.replace('SOURCE', 'kept')} select subject, predicate, object, "
    "arg_max(document_id, document_id::BIGINT) as document_id, 0.8::DOUBLE as weight from pairs group by subject, predicate, object",
    "stored_after_delete": f"with {_LIVE}, {_LEFT} select id, length(text)::INTEGER as chars from stored",
    "stored_keyword_search": _STORED_KEYWORD,
    "stored_after_compact": _STORED_KEYWORD,
    "stored_hybrid_search": "with "
    + ",\n".join(
        [
            _LIVE,
            "stored as (select 'docs' as collection_id, * from live)",
            ITEMS,
            _hashed("q", "items"),
            QUESTIONS,
            _knn("stored", "questions", 5),
            _bm25("stored", "questions", "or"),
            f"kw as ({_best('bm25', 'bm25 desc, id', 10, 'q_id, collection_id, id, bm25')})",
            FUSED,
            f"top as ({_best('fused', FUSED_ORDER, 5, 'q_id, id, score')})",
        ]
    )
    + " select q_id, rank, id, round(score, 10) as score from top",
}

ORACLE |= {
    "stored_ann_search": (
        "with live as (select vec_id::VARCHAR as id, label, case when label in (5, 6) then list_reverse(embedding) else embedding end as embedding "
        "from embeddings where label <> 3) select id as q_id, 1 as rank, min(id) over (partition by embedding) as id, 0.0::DOUBLE as distance from live"
    ),
    "stored_ann_recall": "select (select count(*) from benchmark where text is not null) * "
    "least(5, (select count(*) from documents)) as n_exact, true as recall_reached",
}
