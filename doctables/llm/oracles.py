"""DuckDB statements for the operators that SQL can express, in other formulations than Spark's."""

from __future__ import annotations

#: Distinct 3-word shingles, all pairs that share one, and the closure of the links.
NEAR_DUPLICATES = r"""with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(s) as n from documents left join sh using (doc_id) group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from n union select r.a, l.b from reach r join links l on r.b = l.a)
select n.doc_id, n.n as n_shingles, min(r.b) as component_id, n.doc_id = min(r.b) as kept from n join reach r on r.a = n.doc_id group by n.doc_id, n.n"""

#: Every string of 50 bytes with its smallest document; flagged places joined to runs.
REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
g as (select doc_id, p, substr(x, (2 * p + 1)::bigint, 100) as s from (select *, unnest(range(greatest(n - 49, 0))) as p from d)),
f as (select s, min(doc_id) as first_doc from g group by s),
late as (select doc_id, p, p - lag(p, 1, -1000) over (partition by doc_id order by p) > 50 as fresh from g join f using (s) where first_doc < doc_id),
numbered as (select doc_id, p, sum(fresh::int) over (partition by doc_id order by p) as run from late),
spans as (select doc_id, min(p) as a, max(p) + 50 as b from numbered group by doc_id, run),
gaps as (select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as x0, a as x1 from spans union all select doc_id, max(b), 1000000000 from spans group by doc_id),
kept as (select g.doc_id, string_agg(substr(x, (2 * x0 + 1)::bigint, (2 * (x1 - x0))::bigint), '' order by x0) as k from gaps g join d using (doc_id) group by g.doc_id)
select d.doc_id, d.n as n_bytes, coalesce(s.gone, 0)::bigint as n_removed, coalesce(s.n_spans, 0) as n_spans, sha256(unhex(coalesce(k, x))) as kept_sha256
from d left join (select doc_id, sum(b - a) as gone, count(*) as n_spans from spans group by doc_id) s using (doc_id) left join kept using (doc_id)"""

#: Words and windows by unnesting; lines by their hash, counted by distinct lists of lines.
LINE_RULES = r"""with t as (select doc_id, coalesce(text, '') as text, coalesce(source, 'None') as host from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from t),
win as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as s from (select *, unnest(range(1, len(w) - 6)) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as k from win) where k > 1),
again as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from twice) group by doc_id),
l as (select doc_id, host, unnest(string_split(text, chr(10))) as line from t),
lw as (select *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as plain from l),
dup as (select doc_id, count(*) - count(distinct line) as n from lw where n > 0 group by doc_id),
h as (select doc_id, ('0x' || substr(md5(host || chr(10) || plain), 1, 16))::ubigint::hugeint as u, sum(n) as n from lw where n > 0 group by doc_id, host, plain),
s as (select doc_id, case when u >= 9223372036854775808 then u - 18446744073709551616 else u end as h, n from h),
content as (select doc_id, list(h order by h)::varchar as content from s group by doc_id),
above as (select h from (select distinct h, content from s join content using (doc_id)) group by h having count(*) > 20),
gone as (select doc_id, sum(n) as n from s where h in (select h from above) group by doc_id),
b as (select w.doc_id, len(w.w)::bigint as n_words, list_sum(list_transform(w.w, lambda x: length(x)))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(again.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed_words
    from w left join dup using (doc_id) left join again using (doc_id) left join gone using (doc_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed,
    not base_failed and 100 * (n_words - n_removed_words) >= 30 * n_words as kept from j"""


def _centroids(rounds: int = 3, k: int = 16, width: int = 64) -> str:
    """Every distance of every vector to every centroid, round by round."""
    steps = [f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width}),
c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as w from (select *, sha256('1:' || vec_id) as h from v where vec_id is not null order by h, v limit {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select r, min((d, c)) as best from (
    select v.r, c, list_sum(list_transform(range(1, {width + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::bigint as d from v cross join c{r}) group by r)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (select c, coalesce(m, w) as w from c{r} left join (
    select c, list((s - ((s % n) + n) % n) // n order by i) as m from (
        select best[2] as c, i, sum(v[i])::bigint as s, count(*) as n from (select *, unnest(range(1, {width + 1})) as i from v join a{r} using (r)) group by all) group by c) using (c))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, best[2]::int as cluster, best[1] as distance, sum(best[1]) over (partition by best[2])::bigint as cluster_inertia, sum(best[1]) over ()::bigint as inertia,
    sha256(array_to_string(w, ',')) as centroid_sha256 from v join a{rounds} using (r) join c{rounds} on c = best[2]"""


CENTROIDS = _centroids()

#: Every order of the filters over the patterns of failures, first failure found by position.
FILTER_AUDIT = r"""with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
lab as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 50 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end
    || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as fails
    from w left join lab using (doc_id)),
pat as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (select a.l || b.l || c.l || d.l || e.l as o from x a, x b, x c, x d, x e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
hit as (select part, fails, n, good, toxic, o, list_min(list_transform(string_split(fails, ''), lambda c: strpos(o, c))) as place from pat, orders where fails <> ''
    union all select part, fails, n, good, toxic, o, 99 as place from pat, orders where fails = ''),
total as (select part, sum(n) as n from pat group by part),
steps as (select part, o, i as step, o[i] as l from total, orders, (select unnest([1, 2, 3, 4, 5]) as i)),
done as (select s.part, s.o, s.step, s.l, coalesce(sum(n) filter (place > step), 0) as kept, coalesce(sum(n) filter (place = step), 0) as removed,
    coalesce(sum(n) filter (contains(fails, l) and place < step), 0) as redundant, coalesce(sum(n) filter (fails = l), 0) as unique_fails,
    coalesce(sum(good) filter (place = step), 0) as good_lost, coalesce(sum(toxic) filter (place = step), 0) as toxic_lost
    from steps s join hit on hit.part = s.part and hit.o = s.o group by all)
select part, o as filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, l)::bigint as shapley from done"""
