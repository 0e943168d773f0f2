"""DuckDB forms of the inputs (as CTEs) and the expected result of each query, in other formulations than Spark's."""

from __future__ import annotations

from doctables.functions.fixed_values import PROMPT_HEAD, PROMPT_TAIL

INPUTS = {
    "f1_raw": """select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ln, unnest(string_split(text, chr(10))) as line from documents""",
    "f1": """select doc_id, (1 + place // 25)::int as page_no, (place % 25)::int as line_no, line from (
        select doc_id, ln + ln // 9 as place, line from f1_raw union all select doc_id, ln + ln // 9 + 1, '' from f1_raw where ln % 9 = 8)""",
    "f2_raw": """select doc_id, page_no, line_no, generate_subscripts(string_split(line, ' '), 1) - 1 as i, unnest(string_split(line, ' ')) as text,
        len(string_split(line, ' ')) as n from f1""",
    "f2": """select doc_id, page_no, line_no, (line_no * 100000 + case when line_no % 3 = 0 then n - 1 - i else i end)::bigint as ord, text,
        ((doc_id + i) % 100) / 100.0::double as confidence,
        (i * 40 + (i // 4) * 76 + (doc_id + line_no * 3 + i * 7) % 23)::double as x,
        (line_no * 30 + (doc_id * 7 + line_no * 13 + i * 5) % 11)::double as y,
        (line_no * 12 + (doc_id * 7 + line_no * 5 + i * 2) % 9)::double as y_drift
        from f2_raw where text <> ''""",
    "f4": """select p_brand as page, (row_number() over (partition by p_brand order by p_partkey) - 1)::int as line_no,
        case when p_partkey % 9 = 0 then '   ' when p_partkey % 7 = 0 then '  ' || p_name || '   ' || p_type
             else p_name || '  ' || p_type || '     ' || p_size || '  ' end as line from part""",
    "f5": """select user_id as page, (row_number() over (partition by user_id order by event_id) - 1)::int as line_no,
        case event_type when 'signup' then '  ---+---+---' when 'error' then 'plain ' || event_id when 'click' then 'click | ' || event_id
             else event_type || ' | ' || event_id || ' | 2013-' || (2013 + event_id % 5) end as line from events""",
    "f6_profile": """select l_suppkey as page_id, (l_partkey % 400)::int as y, sum(l_quantity::bigint)::bigint as ink from lineitem group by all""",
    "f6_pixels": """select l_suppkey as page_id, (l_partkey % 400)::int as y, (l_quantity::int * 2 + case when l_returnflag = 'R' then 120 else 0 end)::int as v from lineitem""",
    "f6_edges": """select l_orderkey as page_id, pi() / 2 + (l_discount - 0.05) as theta from lineitem""",
    "f7_docs": """select doc_id, 'in/scan.' || doc_id || case doc_id % 5 when 0 then '.PDF' when 1 then '.pdf' when 2 then '.Pdf' when 3 then '.txt' else '.pdf.bak' end as path
        from documents""",
    "f7": """select doc_id, path, null::varchar as read_error from f7_docs
        union all select -2 * doc_id - 1, 'in/broken.' || doc_id || '.pdf', 'cannot be read' from documents where doc_id % 31 = 6
        union all select -2 * doc_id - 2, 'in/empty.' || doc_id || '.pdf', null from documents where doc_id % 37 = 11""",
    "f7_pages": """select doc_id, (1 + doc_id % 3)::int as page_no, text as ocr_text from documents""",
    "f7b": """select doc_id, (case when doc_id % 17 = 0 then 9 else 1 + doc_id % 3 end)::int as page_no,
        case when doc_id % 11 = 0 then '{"title":"T' || doc_id || '"'
             when doc_id % 13 = 0 then '[{"title":"T' || doc_id || '"}]'
             when doc_id % 19 = 0 then '{"title":"T' || doc_id || '"} x'
             when doc_id % 23 = 0 then '{"title":"T' || doc_id || '","tables":"x"}'
             when doc_id % 7 = 0 then '{"content":"' || lang || '"}'
             when doc_id % 6 = 0 then '{"title":"T' || doc_id || '","content":"' || lang || '","tables":[]}'
             else '{"title":"T' || doc_id || '","content":"' || lang || ' ' || source || '","tables":[{"table_title":"A' || doc_id || '","table_content":"1;2"},{"table_title":"B"}]}'
        end as response from documents""",
    "f9_raw": """select page_id, list_filter(list_transform(string_split(html, '<'), lambda t, i: case when i = 1 then t else '<' || t end),
        lambda t: t <> '') as tags from pages""",
    "f9_tags": """select page_id, (generate_subscripts(tags, 1) - 1)::int as region_no, unnest(tags) as res from f9_raw""",
    "f9": """select page_id, region_no, case when regexp_matches(res, '^<h[0-9]>') then 'title' when res like '<li>%' or res like '<a %' then 'list' else 'text' end as type,
        res from f9_tags""",
    # anchors: a recursive walk over the distinct y of each page
    "ys": "select distinct doc_id, page_no, {y} as y from f2",
    "anchors": """select doc_id, page_no, min(y) as y, 0 as row_no from ys group by all
        union all
        select a.doc_id, a.page_no, min(n.y), a.row_no + 1 from anchors a join ys n on n.doc_id = a.doc_id and n.page_no = a.page_no and n.y > a.y + 15
        group by a.doc_id, a.page_no, a.row_no""",
    "anchored": """select w.*, a.row_no::int as row_no from (select *, {y} as at_y from f2) w asof join anchors a
        on w.doc_id = a.doc_id and w.page_no = a.page_no and w.at_y >= a.y""",
    "anchor_cells": """select *, (row_number() over (partition by doc_id, page_no, row_no order by x, ord) - 1)::int as col_no from anchored""",
    "anchor_widths": """select doc_id, page_no, max(n)::int as width from (select doc_id, page_no, row_no, count(*) as n from anchored group by all) group by all""",
    "anchor_lines": """select doc_id, page_no, row_no, list(text order by x, ord) as cells, any_value(width) as width
        from anchored join anchor_widths using (doc_id, page_no) group by doc_id, page_no, row_no""",
    # clusters: starts are found by an anti join with the gap as range, words look their start up
    "xs": "select distinct doc_id, page_no, line_no, x from f2",
    "x_starts": """select doc_id, page_no, line_no, x, row_number() over (partition by doc_id, page_no, line_no order by x) - 1 as no
        from (select *, lead(x, -1) over (partition by doc_id, page_no, line_no order by x) as before from xs) where before is null or x - before > 100""",
    "clustered": """select w.*, s.no::int as col_no from f2 w asof join x_starts s
        on w.doc_id = s.doc_id and w.page_no = s.page_no and w.line_no = s.line_no and w.x >= s.x""",
    "cluster_cells": "select doc_id, page_no, line_no, col_no, string_agg(text, ' ' order by ord) as text from clustered group by all",
    "binned": "select *, (case when x < 100 then 0 when x < 300 then 1 when x < 500 then 2 else 3 end)::int as col_no from f2",
    "bin_grid": """select g.doc_id, g.page_no, g.line_no, g.col_no, coalesce(string_agg(b.text, ' ' order by b.ord), '') as text
        from (select doc_id, page_no, line_no, unnest([0, 1, 2, 3]) as col_no from f1) g left join binned b using (doc_id, page_no, line_no, col_no)
        group by all""",
    "f4_cells": """select page, line_no, regexp_split_to_array(trim(line), '\\s{2,}') as cells from f4""",
    "f4_rows": """select page, line_no as row_no, cells, max(len(cells)) over (partition by page)::int as width from f4_cells where cells <> ['']""",
    # pipe tables: separators and plain lines alone decide; pipe lines look up the last of them
    "solid": """select *, lag(is_sep, 1, false) over (partition by page order by line_no) as was_sep from (
        select page, line_no, regexp_full_match(line, '\\s*[-+]+\\s*') as is_sep, contains(line, '|') as has_pipe from f5) where is_sep or not has_pipe""",
    "solid_no": """select *, sum((is_sep and not was_sep)::int) over (partition by page order by line_no) - 1 as no,
        is_sep and not was_sep as opening, max_by(is_sep, line_no) over (partition by page) as ends_open,
        sum((is_sep and not was_sep)::int) over (partition by page) - 1 as last_no from solid""",
    "marked": """select f.page, f.line_no, f.line, case when s.is_sep then s.no end::int as table_no,
        coalesce(s.opening and s.line_no = f.line_no, false) as opens,
        case when s.is_sep then not (s.ends_open and s.no = s.last_no) end as closed
        from f5 f asof left join solid_no s on f.page = s.page and f.line_no >= s.line_no""",
    "table_rows": """select page, line_no, table_no, opens, closed, trim(regexp_replace(line, '[-+]+', '|', 'g')) as row_text from marked where table_no is not null""",
    "table_sizes": """select page, table_no, max(length(row_text) - length(replace(row_text, '|', ''))) as w, count(*) as n from table_rows group by all""",
    "normal": """select page, line_no, 0 as piece, table_no, closed, row_text || repeat('|', w - (length(row_text) - length(replace(row_text, '|', '')))) as text
        from table_rows join table_sizes using (page, table_no)
        union all select page, line_no, 1, table_no, closed, '|' || repeat('---|', w) from table_rows join table_sizes using (page, table_no) where opens and n > 1""",
    "stitched": """select page, line_no, case when table_no is not null and opening then piece + 1 else piece end as part, text, closed from (
        select n.*, n.line_no in (select line_no from table_rows t where t.page = n.page and t.opens) as opening from normal n)
        union all select page, line_no, 0, '', closed from table_rows where opens
        union all select page, line_no, 0, line, true from marked where table_no is null""",
    # bands: position minus rank is constant inside a run
    "inked": "select *, y - row_number() over (partition by page_id order by y) as run from f6_profile where ink > 0",
    "bands": """select page_id, (row_number() over (partition by page_id order by min(y)) - 1)::int as band_no, min(y) as y_start, max(y) as y_end
        from inked group by page_id, run""",
    # threshold: every level against the pixels at or below it
    "levels": "select page_id, v, count(*)::double as n from f6_pixels group by all",
    "splits": """select page_id, v, w, s, w0, s0 from (select a.page_id, a.v, any_value(t.w) as w, any_value(t.s) as s, sum(b.n) as w0, sum(b.n * b.v) as s0
        from levels a join levels b on b.page_id = a.page_id and b.v <= a.v
        join (select page_id, sum(n) as w, sum(n * v) as s from levels group by all) t on t.page_id = a.page_id group by a.page_id, a.v)""",
    "scored": "select page_id, v, (w * s0 - w0 * s) * (w * s0 - w0 * s) / (w0 * (w - w0)) as score from splits where w > w0",
    "thresholds": """select p.page_id, coalesce(t.v, 0)::int as threshold from (select distinct page_id from f6_pixels) p
        left join (select page_id, v from scored qualify row_number() over (partition by page_id order by score desc, v) = 1) t using (page_id)""",
    "inked_px": "select p.*, (case when v <= threshold then 255 else 0 end)::int as ink from f6_pixels p join thresholds using (page_id)",
    "matched": "select p.*, a.response from f7_pages p left join f7b a using (doc_id, page_no)",
    "classified": """select *, case when response is null then 'missing' when not json_valid(response) then 'malformed'
        when json_type(response) = 'OBJECT' then 'structured' else 'fallback' end as status from matched""",
    "structured": """select *, coalesce(json_extract_string(r, '$.title'), '') as title, coalesce(json_extract_string(r, '$.content'), '') as content,
        coalesce(json_extract(r, '$.tables')::varchar, '[]') as tables
        from (select *, case when status = 'structured' then response::json end as r from classified) where status = 'structured'""",
    "final_rows": """select doc_id, page_no, page_no::varchar as page, title, content, tables, status from structured
        union all select doc_id, page_no, page_no::varchar, '', ocr_text, '', status from classified where status <> 'structured'""",
}

# Inputs each CTE reads; the statement of a query lists what it needs.
NEEDS = {
    "f1": ["f1_raw"], "f2_raw": ["f1"], "f2": ["f2_raw"], "ys": ["f2"], "anchors": ["ys"], "anchored": ["anchors"],
    "anchor_cells": ["anchored"], "anchor_widths": ["anchored"], "anchor_lines": ["anchor_widths"], "xs": ["f2"], "x_starts": ["xs"],
    "clustered": ["x_starts"], "cluster_cells": ["clustered"], "binned": ["f2"], "bin_grid": ["binned"], "f4_cells": ["f4"],
    "f4_rows": ["f4_cells"], "solid": ["f5"], "solid_no": ["solid"], "marked": ["solid_no"], "table_rows": ["marked"],
    "table_sizes": ["table_rows"], "normal": ["table_sizes"], "stitched": ["normal"], "inked": ["f6_profile"], "bands": ["inked"],
    "levels": ["f6_pixels"], "splits": ["levels"], "scored": ["splits"], "thresholds": ["scored"], "inked_px": ["thresholds"],
    "f7": ["f7_docs"], "f9_tags": ["f9_raw"], "f9": ["f9_tags"], "matched": ["f7_pages", "f7b"], "classified": ["matched"], "structured": ["classified"], "final_rows": ["structured"],
}


def statement(inputs: str, select: str, **names: str) -> str:
    """A query with the CTEs it needs in front."""
    found: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in found:
            found.append(name)

    for name in inputs.split():
        add(name)
    ctes = [f"{name} as ({INPUTS[name]})" for name in found]
    text = "with recursive " + ",\n".join(ctes) + "\n" + select if ctes else select
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT = f"select doc_id, page_no, {_quote(PROMPT_HEAD)} || ocr_text || {_quote(PROMPT_TAIL)} as prompt from f7_pages"
