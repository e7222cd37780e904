"""The operators' results as DuckDB SQL, where SQL can express them."""

ORACLE = {}

WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontaminate"] = f"""
with d as (select doc_id, coalesce({WORDS.format('text')}, []) as w from documents),
b as (select item_id, {WORDS.format('text')} as w from benchmark where text is not null),
lengths as (select item_id, w, least(10, len(w)) as k from b where len(w) > 0),
windows as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as gram
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from lengths)
),
spots as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as gram
  from (
    select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
    from d cross join (select distinct k from windows) where len(w) >= k
  )
),
found as (select doc_id, i, k, item_id from spots join windows using (k, gram)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


def _level(i: int, level: str, parent: list[str], weight: str) -> str:
    """The budgets of one level: children in order of capacity / weight, the full ones first."""
    on = ", ".join([*parent, level])
    family = f"partition by {', '.join(parent)}" if parent else "partition by 1"
    order = f"{family} order by capacity::double / weight, {level}"
    source = f"join n{i - 1} using ({', '.join(parent)})" if parent else "cross join root"
    return f"""
c{i} as (select {on}, sum(capacity)::hugeint as capacity from leaves group by {on}),
w{i} as (select c{i}.*, budget, ({weight})::hugeint as weight from c{i} {source}),
t{i} as (
  select *, (budget - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0)) * weight
    >= capacity * sum(weight) over ({order} rows between current row and unbounded following) as full_child
  from w{i}
),
r{i} as (
  select *, (budget - coalesce(sum(capacity) filter (full_child) over ({family}), 0))::hugeint as left_over,
    (sum(weight) filter (not full_child) over ({family}))::hugeint as rest_weight
  from t{i}
),
p{i} as (select *, case when full_child then capacity else (left_over * weight) // rest_weight end as part from r{i}),
n{i} as (
  select {on}, (part + case when not full_child and
      row_number() over ({family} order by full_child, capacity::double / weight, {level}) <= budget - sum(part) over ({family})
    then 1 else 0 end)::hugeint as budget
  from p{i}
)"""


ORACLE["op3_mixing"] = f"""
with d as (
  select doc_id, '=' || 'domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as integer) % 4) as a, '=' || lang as b, '=' || source as c,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens
  from documents
),
leaves as (select a, b, c, sum(tokens) as supply, sum(tokens) * 2 as capacity from d group by a, b, c),
root as (select least(floor(sum(supply) * 0.8::double), sum(capacity))::hugeint as budget from leaves),
{_level(0, "a", [], "case a when '=domain0' then 3 when '=domain1' then 2 else 1 end")},
{_level(1, "b", ["a"], "case b when '=en' then 4 when '=de' then 2 when '=fr' then 2 else 1 end")},
{_level(2, "c", ["a", "b"], "1")},
plan as (
  select a, b, c, (budget // supply)::bigint as epochs, (budget % supply)::bigint as prefix
  from leaves join n2 using (a, b, c) where supply > 0 and budget > 0
),
drawn as (
  select *, coalesce(sum(tokens) over (partition by a, b, c order by md5('mix:' || epochs || ':' || doc_id), doc_id
    rows between unbounded preceding and 1 preceding), 0) as start
  from d join plan using (a, b, c)
),
used as (select *, case when start < prefix then least(tokens, prefix - start) end as part from drawn)
select doc_id, substr(a, 2) as domain, substr(b, 2) as lang, substr(c, 2) as source, tokens as n_tokens,
  (epochs + (part is not null)::int)::bigint as copies, (epochs * tokens + coalesce(part, 0))::bigint as used_tokens
from used where epochs + (part is not null)::int > 0
"""

ORACLE["op7_line_dedup"] = r"""
with split as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as raw
  from documents where text is not null
),
clean as (
  select doc_id, raw, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as line
  from split
),
numbered as (
  select doc_id, raw, line, len(string_split(line, ' ')) as words, row_number() over (partition by doc_id order by raw) - 1 as i
  from clean where line <> ''
),
counted as (
  select *, coalesce(sum(words) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start,
    sum(words) over (partition by doc_id) as total
  from numbered
),
windows as (
  select doc_id, i, max(i) over w as j, list(line) over w as content, start + 50 <= total as is_full
  from counted window w as (partition by doc_id order by start range between current row and 49 following)
),
placed as (
  select doc_id, i, j, first_value(doc_id) over f as other, first_value(i) over f as other_i
  from windows where is_full window f as (partition by content order by doc_id, i)
),
later as (select *, i - other_i as gap from placed where (doc_id, i) <> (other, other_i)),
fresh as (
  select *, (coalesce(max(j) over (partition by doc_id, other, gap order by i rows between unbounded preceding and 1 preceding), -2) + 1 < i)::int as fresh
  from later
),
runs as (
  select doc_id, other, gap, min(i) as i, max(j) as j
  from (select *, sum(fresh) over (partition by doc_id, other, gap order by i) as run from fresh) group by doc_id, other, gap, run
),
arrays as (select doc_id, list(line order by i) as lines, list(raw order by i) as raws from numbered group by doc_id),
met as (
  select r.*, a.lines, a.raws, b.lines as others,
    least(r.i, r.i - gap) as room_left, least(len(a.lines) - r.j, len(b.lines) - (r.j - gap)) - 1 as room_right
  from runs r join arrays a on r.doc_id = a.doc_id join arrays b on r.other = b.doc_id
),
grown as (
  select doc_id, raws,
    i - coalesce(nullif(list_position(list_transform(range(1, room_left + 1), lambda x: lines[i - x + 1] = others[i - gap - x + 1]), false), 0) - 1, room_left) as i,
    j + coalesce(nullif(list_position(list_transform(range(1, room_right + 1), lambda x: lines[j + x + 1] = others[j - gap + x + 1]), false), 0) - 1, room_right) as j
  from met
),
gone as (select distinct doc_id, unnest(range(raws[i + 1], raws[j + 1] + 1)) as raw from grown),
kept as (
  select s.doc_id, count(*) as n_lines, count(g.raw) as n_deleted, coalesce(string_agg(line, chr(10) order by raw) filter (g.raw is null), '') as text
  from split s left join gone g using (doc_id, raw) group by s.doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted,
  length(coalesce(k.text, '')) as kept_chars, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""

# The CRC-32 of a word from the table of its polynomial, byte by byte.
ORACLE["op13_resampling"] = f"""
with crc as (
  select list(list_reduce([i] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t
  from (select unnest(range(256)) as i)
),
d as (select doc_id, coalesce({WORDS.format('text')}, []) as w from documents),
tokens as (select doc_id, unnest(w) as word from d),
wanted as (select unnest({WORDS.format('text')}) as word from benchmark),
known as (
  select word, xor(4294967295, list_reduce(
      [4294967295::bigint] || list_transform(range(1, length(hex(word)), 2), lambda i: ('0x' || substr(hex(word), i, 2))::bigint),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 10000 as bucket
  from (select word from tokens union select word from wanted), crc
),
s as (select bucket, count(*) as n from tokens join known using (word) group by bucket),
t as (select bucket, count(*) as n from wanted join known using (word) group by bucket),
gain as (
  select bucket, floor(1000 * ln(
    ((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + 10000))::double
    / ((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0) from t) + 10000))::double))::bigint as gain
  from s full join t using (bucket)
),
weighed as (
  select doc_id, sum(gain)::bigint as weight from tokens join known using (word) join gain using (bucket) group by doc_id
),
scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from d left join weighed using (doc_id)
),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from drawn) then rank end as rank
from scored left join drawn using (doc_id)
"""

ORACLE["op12_occurrence"] = r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
  from documents
),
s as (
  select distinct doc_id, unnest(case when len(w) between 1 and 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as gram
  from d
),
n as (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as u, b.doc_id as v, count(*) as both_n from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by u, v),
links as (
  select u, v from met join n a on a.doc_id = u join n b on b.doc_id = v where 100 * both_n >= 85 * (a.n + b.n - both_n)
),
arcs as (select u, v from links union select v, u from links),
reach as (select doc_id, doc_id as other from d union select doc_id, v from reach join arcs on other = u),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from d join least using (doc_id) left join n using (doc_id)
"""

ORACLE["op11_hard_negatives"] = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
met as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from rows a join rows r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from met where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join met using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
