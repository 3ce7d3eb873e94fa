"""SQL that gives the results of the registered queries, over the same tables.

The derived document pairs are common tables of plain integer arithmetic; every
statement takes those it needs.
"""

from __future__ import annotations

#: Fixed values, written out so that they don't follow the code they check: digits and their ASCII forms,
#: points off and how many at most, the letters of the derived pairs.
DIGITS_FROM = "０１２３４５６７８９．，٠١٢٣٤٥٦٧٨٩٫٬۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "0123456789.,0123456789.,0123456789"
DEDUCTIONS = {"info": 0.0, "low": 1.0, "medium": 4.0, "high": 10.0, "critical": 25.0}
CAPS = {
    "region_shifted": 12.0,
    "region_resized": 10.0,
    "text_fragmented": 10.0,
    "text_overflow": 25.0,
    "text_clipped": 25.0,
    "abnormal_wrap": 10.0,
    "line_count_explosion": 10.0,
    "font_shrink": 10.0,
    "text_overlap": 10.0,
    "text_image_overlap": 25.0,
    "content_out_of_page": 25.0,
    "missing_element": 10.0,
    "added_element": 3.0,
    "missing_image": 25.0,
    "typography_changed": 10.0,
    "table_structure_changed": 25.0,
    "page_missing": 25.0,
    "number_mismatch": 12.0,
    "untranslated_text": 12.0,
    "glossary_violation": 12.0,
    "invisible_text": 25.0,
    "text_rasterized": 10.0,
    "text_vectorized": 0.0,
    "text_alignment_changed": 10.0,
    "other": 10.0,
}
LATIN = "abcdefghijklmnopqrstuvwxyz"
CJK = "的一是不了人我在有他这为之大来以个中上们到说国和地也"

_NUMBER = r"\d+(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_TEXTS = "('text','paragraph','heading','list','header','footer')"


def _position(a: str, b: str) -> str:
    dx, dy = f"({a}.x + {a}.width / 2 - ({b}.x + {b}.width / 2))", f"({a}.y + {a}.height / 2 - ({b}.y + {b}.height / 2))"
    return f"greatest(0.0::double, 1 - sqrt({dx} * {dx} + {dy} * {dy}) / sqrt(500.0::double * 500.0::double + 800.0::double * 800.0::double))"


def _size(a: str, b: str) -> str:
    return f"((least({a}.width, {b}.width) / greatest({a}.width, {b}.width) + least({a}.height, {b}.height) / greatest({a}.height, {b}.height)) / 2)"


def _shared(a: str, b: str) -> str:
    wide = f"greatest(0.0::double, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    return f"({wide} * greatest(0.0::double, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y)))"


def _overlap(a: str, b: str) -> str:
    return f"({_shared(a, b)} / least({a}.width * {a}.height, {b}.width * {b}.height))"


def _inside(a: str, b: str) -> str:
    x, y = f"({a}.x + {a}.width / 2)", f"({a}.y + {a}.height / 2)"
    return f"({b}.x <= {x} and {x} <= {b}.x + {b}.width and {b}.y <= {y} and {y} <= {b}.y + {b}.height)"


def _script_count(text: str, name: str) -> str:
    letters = {"latin": "A-Za-z", "cjk": "\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}"}[name]
    return f"length(regexp_replace(coalesce({text}, ''), '[^{letters}]', '', 'g'))"


_ACRONYMS = "coalesce(list_sum(list_transform(list_filter(regexp_extract_all(t.text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}')), lambda w: length(w))), 0)"
_NUMBERS = f"list_transform(regexp_extract_all(translate(coalesce(text, ''), '{DIGITS_FROM}', '{DIGITS_TO}'), '{_NUMBER}'), lambda n: case when contains(n, '.') then regexp_replace(split_part(replace(n, ',', ''), '.', 1), '^0+(.)', '\\1') || '.' || split_part(n, '.', 2) else regexp_replace(replace(n, ',', ''), '^0+(.)', '\\1') end)"


def _milli(v: str) -> str:
    return f"cast(cast(floor(({v}) * 1000000 + 0.5) as bigint) as varchar)"


def _boxed(a: str) -> str:
    return " || ',' || ".join(_milli(f"{a}.{c}") for c in ("x", "y", "width", "height"))


def _side(name: str, a: str) -> dict[str, str]:
    return {f"{name}_text": f"{a}.text", f"{name}_bbox": _boxed(a), f"{name}_region_type": f"{a}.type"}


def _match(s: str, t: str, order: str, kind: str) -> dict[str, str]:
    position, size = _position(s, t), _size(s, t)
    score = f"0.4::double * {position} + 0.25::double * {size} + 0.2::double * {kind} + 0.15::double * {order}"
    return {"match_score": _milli(score), "match_position_similarity": _milli(position), "match_size_similarity": _milli(size), "match_type_similarity": _milli(kind), "match_order_similarity": _milli(order)}


def _told() -> str:
    """SQL for every key of every issue of the known pairs: each type's keys, written out."""
    e_s, e_t = _side("source", "s"), _side("target", "t")
    order = "(1 - abs(s.region_ord / greatest(1, s.n - 1) - t.region_ord / greatest(1, t.n - 1)))"
    match = _match("s", "t", order, f"(case when s.type = t.type then 1.0::double when s.type in {_TEXTS} and t.type in {_TEXTS} then 0.8::double else 0.0::double end)")
    font = {"font_size_change_ratio": _milli("d.fc")} | e_s | e_t | match
    overlap = {"overlap_ratio": _milli("l.ratio"), "source_overlap_ratio": _milli("l.before"), "overlap_increase_ratio": _milli("l.ratio - l.before"), "other_region": "o.region_id", "primary_text": "t.text", "other_text": "o.text", "primary_region_type": "t.type", "other_region_type": "o.type", "other_bbox": _boxed("o")} | e_t
    letters = "cast(length(regexp_replace(t.text, '[^\\p{L}]', '', 'g')) as varchar)"
    some_source = {k: v for k, v in e_s.items() if k != "source_text"}
    script = "length(regexp_replace(coalesce(t.text, ''), '[^{0}]', '', 'g'))"
    latin, cjk = script.format("A-Za-z"), script.format("\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}")
    numbers = {"source_numbers": "coalesce(nl.src, '')", "target_numbers": "coalesce(nl.tgt, '')", "missing_numbers": "coalesce(nl.missing, '')", "extra_numbers": "coalesce(nl.extra, '')", "diff_count": "cast(nm.missing + nm.extra as bigint)::varchar"}
    # type, whose regions there must be, keys
    kinds: list[tuple[str, str, dict[str, str]]] = [
        ("i.type in ('missing_element', 'missing_image')", "", {"region_type": "s.type"} | e_s),
        ("i.type = 'added_element' and i.kind = 'pair'", "", {"region_type": "t.type"} | e_t),
        ("i.type = 'region_shifted'", "", {"x_shift_ratio": _milli("d.dx"), "y_shift_ratio": _milli("d.dy")} | e_s | e_t | match),
        ("i.type in ('font_shrink', 'typography_changed')", "", font),
        ("i.type = 'region_resized'", "", {"width_change_ratio": _milli("d.dw"), "height_change_ratio": _milli("d.dh"), "resize_magnitude": _milli("greatest(abs(d.dw), abs(d.dh))")} | e_s | e_t | match),
        ("i.type = 'text_fragmented'", "", {"text": "t.text", "bbox_width": _milli("t.width"), "letter_count": letters, "source_text": "s.text"} | e_t),
        ("i.type = 'text_fragmented'", "s.pair_id is not null", some_source),
        ("i.type = 'invisible_text'", "", {"text_color": "t.color", "background_color": "'#FFFFFF'", "text_opacity": _milli("t.opacity"), "text": "left(t.text, 60)", "source_text": "s.text"} | e_t),
        ("i.type = 'invisible_text'", "s.pair_id is not null", some_source),
        ("i.type = 'content_out_of_page'", "", {"page_width": "'500000000'", "page_height": "'800000000'"} | e_t),
        ("i.type in ('text_overlap', 'text_image_overlap')", "", overlap),
        ("i.type = 'text_vectorized'", "", {"source_text_chars": "v.source_chars::varchar", "target_text_chars": "v.target_chars::varchar"}),
        ("i.type = 'number_mismatch'", "", numbers),
        ("i.type = 'number_mismatch'", "s.pair_id is not null", e_s),
        ("i.type = 'number_mismatch'", "t.pair_id is not null", e_t),
        ("i.type = 'untranslated_text'", "", {"source_script": "'latin'", "source_language_ratio": _milli(f"round({latin} / ({latin} + {cjk}), 3)"), "threshold": "'700000'", "sample": "left(t.text, 60)"} | e_s | e_t | match),
    ]
    joined = """issues i left join sr s on s.pair_id = i.pair_id and s.report_page = i.report_page and s.region_id = i.s_id left join tr t on t.pair_id = i.pair_id and t.report_page = i.report_page and t.region_id = i.t_id
        left join d on d.pair_id = i.pair_id and d.report_page = i.report_page and d.t_id = i.t_id and d.s_id = i.s_id left join new_laps l on i.det = 9 and l.pair_id = i.pair_id and l.report_page = i.report_page and i.ro = l.a * 1000000 + l.b
        left join tr o on o.pair_id = l.pair_id and o.report_page = l.report_page and o.region_ord = l.b left join vec v on i.det = 10 and v.pair_id = i.pair_id and v.report_page = i.report_page
        left join number_lists nl on i.det = 11 and nl.pair_id = i.pair_id and nl.report_page = i.report_page left join numbers nm on i.det = 11 and nm.pair_id = i.pair_id and nm.report_page = i.report_page"""
    lists = ", ".join(f"case when {kind}{f' and {there}' if there else ''} then [" + ", ".join(f"{{'key': '{k}', 'value': cast({v} as varchar)}}" for k, v in keys.items()) + "] else [] end" for kind, there, keys in kinds)
    pages = "select i.pair_id, i.report_page, i.issue_id, case when i.kind = 'missing' then 'source_region_count' else 'target_region_count' end as key, count(r.region_id)::varchar as value from issues i left join regions r on r.pair_id = i.pair_id and r.page = i.report_page and r.side = case when i.kind = 'missing' then 'source' else 'target' end where i.kind <> 'pair' group by all"
    return f"select pair_id, report_page, issue_id, u.key as key, u.value as value from (select i.pair_id, i.report_page, i.issue_id, unnest(flatten([{lists}])) as u from {joined} where i.kind = 'pair') union all {pages}"


def _main_scripts() -> str:
    """Texts put into each script (26 letters from a first one on for a to z), and the script with most letters, no tie."""
    first = {"latin": 0x61, "cjk": 0x4E00, "arabic": 0x0620, "hebrew": 0x05D0, "cyrillic": 0x0430, "greek": 0x03B1, "devanagari": 0x0905, "bengali": 0x0985, "thai": 0x0E01, "hangul": 0xAC00, "kana": 0x3041}
    letters = {"latin": "A-Za-z", "cjk": "一-鿿㐀-䶿", "arabic": "ؠ-يٮ-ۓ", "hebrew": "ְ-ת", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽἀ-῿", "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "thai": "฀-๿", "hangul": "가-힯ᄀ-ᇿ", "kana": "぀-ヿ"}
    alphabets = ", ".join("'" + "".join(chr(v + k) for k in range(26)) + "'" for v in first.values())
    put = lambda k: f"translate(left(text, 200), 'abcdefghijklmnopqrstuvwxyz', ([{alphabets}])[({k}) % 11 + 1])"
    counts = ", ".join(f"{{'n': length(t) - length(regexp_replace(t, '[{c}]', '', 'g')), 's': '{name}'}}" for name, c in letters.items())
    return f"select doc_id, case when v[1].n > 0 and v[1].n > v[2].n then v[1].s end as script, length(t) - length(regexp_replace(t, '[{''.join(letters.values())}]', '', 'g')) as letters from (select *, list_sort([{counts}], 'desc') as v from (select doc_id, case when doc_id % 4 = 3 then {put('doc_id')} || ' ' || {put('doc_id + 1')} else {put('doc_id')} end as t from documents where text is not null))"


#: common tables by name, in the order in which one may use another
CTES = {
    "lines": "select doc_id as pair_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null",
    "src": """select pair_id, i, i // 12 + 1 as page, i % 12 as slot, case when (pair_id * 7 + i) % 11 = 0 then 'image' else 'text' end as type,
        cast(20 + 5 * ((pair_id + i) % 4) as double) as x, cast(20 + 60 * (i % 12) as double) as y, cast(least(400, 10 + 4 * length(line)) as double) as width, cast(30 as double) as height,
        case when (pair_id * 7 + i) % 11 <> 0 then case when i % 9 = 0 then 16.0::double else 10.0::double end end as font_size,
        case when (pair_id * 7 + i) % 11 <> 0 then 1.0::double end as opacity, case when (pair_id * 7 + i) % 11 <> 0 then '#000000' end as color,
        case when (pair_id * 7 + i) % 11 <> 0 then line || ' ' || (pair_id % 100 + i) end as text, line, (pair_id * 31 + i * 17) % 97 as h, pair_id % 10 as edit, i % 12 as ord from lines""",
    "kept": "select *, case when edit = 1 and page > 2 then page - 1 when edit = 2 then page + 1 else page end as to_page from src where h <> 3 and not (edit = 1 and page = 2)",
    "tgt": f"""select pair_id, i, to_page as page, slot, type, x + case h when 5 then 60.0::double when 7 then 90.0::double else 0.0::double end as x, case h when 29 then 790.0::double when 31 then y + 50 else y end as y,
        case h when 19 then width * 0.375::double when 23 then width * 0.125::double when 43 then 12.0::double else width end as width, height, font_size * case h when 11 then 0.7::double when 13 then 0.5::double when 17 then 1.5::double else 1.0::double end as font_size,
        case when type = 'text' then case when h = 37 then 0.0::double else 1.0::double end end as opacity, case when type = 'text' then case when h = 59 then '#FFFFFF' else '#000000' end end as color,
        case when type = 'text' then case when edit = 3 and page = 1 then '' when h = 43 then 'AB' when h = 53 then text when h = 41 then translate(line || ' ' || (pair_id % 100 + i + 1), '{LATIN}', '{CJK}') else translate(text, '{LATIN}', '{CJK}') end end as text, slot as ord from kept
        union all select pair_id, i + 100000, to_page, slot, 'text', 430.0::double, y, 40.0::double, 20.0::double, 10.0::double, 1.0::double, '#000000', '新', slot + 12 from kept where h = 47
        union all select doc_id, 200000, 1, 0, 'text', 20.0::double, 20.0::double, 100.0::double, 30.0::double, 10.0::double, 1.0::double, '#000000', '新页', 0 from documents where text is not null and doc_id % 10 = 2""",
    "spans": "select pair_id, 'source' as side, i, page, ord, type, x, y, width, height, font_size, opacity, color, text from src union all select pair_id, 'target', i, page, ord, type, x, y, width, height, font_size, opacity, color, text from tgt",
    "fonts": "select pair_id, side, page, median(font_size) as median_font from spans where type = 'text' and font_size is not null group by all",
    "regions": """select s.pair_id, s.side, s.page, i, 'p' || s.page || '-r' || ord as region_id, case when type = 'image' then 'image' when coalesce(font_size >= median_font * 1.25, false) then 'heading' else 'paragraph' end as type,
        x, y, width, height, case when type <> 'image' then font_size end as font_size, color, case when type = 'image' then text else coalesce(text, '') end as text, opacity,
        row_number() over (partition by s.pair_id, s.side, s.page order by y, x, ord) - 1 as region_ord from spans s left join fonts f using (pair_id, side, page)""",
    "s_pages": "select distinct pair_id, page, case when pair_id % 10 = 1 and page = 2 then null when pair_id % 10 = 1 and page > 2 then page - 1 when pair_id % 10 = 2 then page + 1 else page end as to_page from spans where side = 'source'",
    "t_pages": "select distinct pair_id, page from spans where side = 'target'",
    "entries": "select coalesce(s.pair_id, t.pair_id) as pair_id, s.page as s_page, t.page as t_page, coalesce(s.page, t.page) as report_page, case when t.page is null then 'missing' when s.page is null then 'extra' else 'pair' end as kind from s_pages s full join t_pages t on s.pair_id = t.pair_id and s.to_page = t.page",
    "sr": "select e.report_page, e.t_page, r.*, count(*) over (partition by r.pair_id, r.page) as n from regions r join entries e on r.pair_id = e.pair_id and r.page = e.s_page and e.kind = 'pair' where side = 'source'",
    "tr": "select e.report_page, e.t_page, r.*, count(*) over (partition by r.pair_id, r.page) as n from regions r join entries e on r.pair_id = e.pair_id and r.page = e.t_page and e.kind = 'pair' where side = 'target'",
    "m": "select s.pair_id, s.report_page, s.t_page, s.region_id as s_id, t.region_id as t_id, s.i from sr s join tr t using (pair_id, report_page, i)",
    "d": """select m.*, s.region_ord as s_ord, t.region_ord as t_ord, s.type as s_type, t.type as t_type, s.text as s_text, t.text as t_text, t.width as t_width,
        (t.x - s.x) / 500 as dx, (t.y - s.y) / 800 as dy, (t.width - s.width) / s.width as dw, (t.height - s.height) / s.height as dh, (t.font_size - s.font_size) / s.font_size as fc, coalesce(s.color <> t.color, false) as color_changed
        from m join sr s on s.pair_id = m.pair_id and s.report_page = m.report_page and s.i = m.i join tr t on t.pair_id = m.pair_id and t.report_page = m.report_page and t.i = m.i""",
    "alone_s": "select sr.* from sr where not exists (select 1 from m where m.pair_id = sr.pair_id and m.report_page = sr.report_page and m.s_id = sr.region_id)",
    "alone_t": "select tr.* from tr where not exists (select 1 from m where m.pair_id = tr.pair_id and m.report_page = tr.report_page and m.t_id = tr.region_id)",
    "analog": f"""select pair_id, report_page, t_ord, a_ord, ax as x, ay as y, aw as width, ah as height, score from (select t.pair_id, t.report_page, t.region_ord as t_ord, s.region_ord as a_ord, s.x as ax, s.y as ay, s.width as aw, s.height as ah,
        0.7::double * {_position('s', 't')} + 0.3::double * {_size('s', 't')} as score, row_number() over (partition by t.pair_id, t.report_page, t.region_ord order by 0.7::double * {_position('s', 't')} + 0.3::double * {_size('s', 't')} desc, s.region_ord) as nth
        from tr t join sr s on s.pair_id = t.pair_id and s.report_page = t.report_page and (s.type = t.type or (s.type in {_TEXTS} and t.type in {_TEXTS}))) where nth = 1 and score >= 0.45""",
    "laps": f"""select t.pair_id, t.report_page, t.t_page, t.region_ord as a, o.region_ord as b, t.region_id as a_id, o.region_id as b_id, t.type in {_TEXTS} as text_first, t.type = 'image' or o.type = 'image' as with_image, {_overlap('t', 'o')} as ratio,
        case when t.type in {_TEXTS} then t.width * t.height else o.width * o.height end as text_area, case when t.type in {_TEXTS} then {_inside('t', 'o')} else {_inside('o', 't')} end as inside
        from tr t join tr o on t.pair_id = o.pair_id and t.report_page = o.report_page and t.region_ord < o.region_ord and t.y < o.y + o.height and o.y < t.y + t.height where {_overlap('t', 'o')} > 0.05 and (t.type in {_TEXTS} or o.type in {_TEXTS}) and (t.type in {_TEXTS} or t.type = 'image') and (o.type in {_TEXTS} or o.type = 'image')""",
    "new_laps": f"""select l.*, coalesce({_overlap('p', 'q')}, 0.0) as before from laps l left join analog p on p.pair_id = l.pair_id and p.report_page = l.report_page and p.t_ord = l.a left join analog q on q.pair_id = l.pair_id and q.report_page = l.report_page and q.t_ord = l.b
        where (not with_image or (text_area / 400000.0 > 0.005 and inside and not coalesce(case when text_first then {_inside('p', 'q')} else {_inside('q', 'p')} end, false))) and ratio - coalesce({_overlap('p', 'q')}, 0.0) > 0.05""",
    "vec": "select e.pair_id, e.report_page, e.t_page, sc.n as source_chars, coalesce(tc.n, 0) as target_chars from entries e join (select pair_id, report_page, sum(length(coalesce(text, ''))) as n from sr group by all) sc using (pair_id, report_page) left join (select pair_id, report_page, sum(length(coalesce(text, ''))) as n from tr group by all) tc using (pair_id, report_page) where e.kind = 'pair' and sc.n >= 30 and coalesce(tc.n, 0) <= sc.n * 0.1",
    "votes": f"""select pair_id, report_page, side, script, count(*) as n from (select pair_id, report_page, side, case when l > c then 'latin' when c > l then 'cjk' end as script from (select pair_id, report_page, side, {_script_count('text', 'latin')} as l, {_script_count('text', 'cjk')} as c from (select * from sr union all select * from tr))) where script is not null group by all""",
    "scripts": "select pair_id, report_page, side, case when count(*) > 1 then 'mixed' else min(script) end as script from (select *, max(n) over (partition by pair_id, report_page, side) as top from votes) where n = top group by all",
    "nums": f"select pair_id, report_page, side, region_ord, region_id, unnest({_NUMBERS}) as number from (select * from sr union all select * from tr)",
    "bag": "select pair_id, report_page, number, count(*) filter (where side = 'source') as a, count(*) filter (where side = 'target') as b from nums group by all",
    "numbers": "select pair_id, report_page, sum(greatest(0, a - b)) as missing, sum(greatest(0, b - a)) as extra from bag group by all having sum(abs(a - b)) > 0",
    "number_lists": """select pair_id, report_page, string_agg(number, ',' order by number) filter (where what = 'source') as src, string_agg(number, ',' order by number) filter (where what = 'target') as tgt, string_agg(number, ',' order by number) filter (where what = 'missing') as missing, string_agg(number, ',' order by number) filter (where what = 'extra') as extra
        from (select pair_id, report_page, side as what, number from nums union all select pair_id, report_page, 'missing', number from (select *, unnest(range(greatest(0, a - b))) from bag) union all select pair_id, report_page, 'extra', number from (select *, unnest(range(greatest(0, b - a))) from bag)) group by all""",
    "issues": f"""select pair_id, report_page, report_page as page, 'p' || report_page || '-missing-page' as issue_id, 'page_missing' as type, 'critical' as severity, null as s_id, null as t_id, 'missing' as kind, 0 as det, 0 as ro from entries where kind = 'missing'
        union all select pair_id, report_page, report_page, 'p' || report_page || '-extra-page', 'added_element', 'high', null, null, 'extra', 0, 0 from entries where kind = 'extra'
        union all select pair_id, report_page, page, 'p' || page || '-missing-' || region_id, case when type = 'image' then 'missing_image' else 'missing_element' end, case when type = 'image' then 'critical' else 'high' end, region_id, null, 'pair', 2, region_ord from alone_s s
            where not (type <> 'image' and exists (select 1 from tr o where o.pair_id = s.pair_id and o.report_page = s.report_page and o.type in {_TEXTS} and {_overlap('s', 'o')} >= 0.4)) and not (type <> 'image' and exists (select 1 from vec v where v.pair_id = s.pair_id and v.report_page = s.report_page))
        union all select pair_id, report_page, page, 'p' || page || '-added-' || region_id, 'added_element', 'low', null, region_id, 'pair', 3, region_ord from alone_t
        union all select pair_id, report_page, t_page, 'p' || t_page || '-shift-' || t_id, 'region_shifted', case when greatest(abs(dx), abs(dy)) > 0.15 then 'high' else 'medium' end, s_id, t_id, 'pair', 5, s_ord * 4 from d where greatest(abs(dx), abs(dy)) > 0.05
        union all select pair_id, report_page, t_page, 'p' || t_page || '-font-' || t_id, 'font_shrink', case when abs(fc) >= 0.4 then 'high' when abs(fc) >= 0.2 then 'medium' else 'high' end, s_id, t_id, 'pair', 5, s_ord * 4 + 1 from d where fc < -0.2
        union all select pair_id, report_page, t_page, 'p' || t_page || '-fontgrow-' || t_id, 'typography_changed', 'medium', s_id, t_id, 'pair', 5, s_ord * 4 + 2 from d where fc > 0.25
        union all select pair_id, report_page, t_page, 'p' || t_page || '-resize-' || t_id, 'region_resized', case when greatest(abs(dw), abs(dh)) >= 0.8 then 'high' when greatest(abs(dw), abs(dh)) >= 0.5 then 'medium' else 'high' end, s_id, t_id, 'pair', 5, s_ord * 4 + 3 from d where greatest(abs(dw), abs(dh)) > 0.5
            and not (s_type in {_TEXTS} and t_type in {_TEXTS} and length(regexp_replace(s_text, '\\s', '', 'g')) <= 30 and length(regexp_replace(t_text, '\\s', '', 'g')) <= 30 and abs(dh) <= 0.2 and (fc is null or abs(fc) <= 0.1) and abs(dw) > abs(dh))
        union all select t.pair_id, t.report_page, t.page, 'p' || t.page || '-frag-' || t.region_id, 'text_fragmented', 'medium', m.s_id, t.region_id, 'pair', 6, t.region_ord from tr t left join m on m.pair_id = t.pair_id and m.report_page = t.report_page and m.t_id = t.region_id where t.type in {_TEXTS} and t.width <= 18 and length(regexp_replace(t.text, '[^\\p{{L}}]', '', 'g')) between 1 and 3
        union all select t.pair_id, t.report_page, t.page, 'p' || t.page || '-invisible-' || t.region_id, 'invisible_text', 'high', m.s_id, t.region_id, 'pair', 7, t.region_ord from tr t left join m on m.pair_id = t.pair_id and m.report_page = t.report_page and m.t_id = t.region_id where t.type in {_TEXTS} and (coalesce(t.opacity <= 0.01, false)
            or (t.color = '#FFFFFF' and not exists (select 1 from tr i where i.pair_id = t.pair_id and i.report_page = t.report_page and i.type = 'image' and {_shared('t', 'i')} >= 0.3::double * (t.width * t.height))))
        union all select pair_id, report_page, page, 'p' || page || '-out-' || region_id, 'content_out_of_page', 'critical', null, region_id, 'pair', 8, region_ord from tr where x < 0 or y < 0 or x + width > 500 or y + height > 800
        union all select pair_id, report_page, t_page, 'p' || t_page || '-overlap-' || a_id || '-' || b_id, case when with_image then 'text_image_overlap' else 'text_overlap' end, case when with_image then 'critical' else 'high' end, null, a_id, 'pair', 9, a * 1000000 + b from new_laps
        union all select pair_id, report_page, t_page, 'p' || t_page || '-vectorized', 'text_vectorized', 'info', null, null, 'pair', 10, 0 from vec
        union all select n.pair_id, n.report_page, e.t_page, 'p' || e.t_page || '-numbers', 'number_mismatch', case when missing + extra >= 5 then 'high' else 'medium' end, sa.region_id, coalesce(ta.region_id, m.t_id), 'pair', 11, 0 from numbers n join entries e on e.pair_id = n.pair_id and e.report_page = n.report_page and e.kind = 'pair'
            left join (select pair_id, report_page, arg_min(region_id, region_ord) as region_id from nums join bag using (pair_id, report_page, number) where side = 'source' and a > b group by all) sa on sa.pair_id = n.pair_id and sa.report_page = n.report_page
            left join (select pair_id, report_page, arg_min(region_id, region_ord) as region_id from nums join bag using (pair_id, report_page, number) where side = 'target' and b > a group by all) ta on ta.pair_id = n.pair_id and ta.report_page = n.report_page
            left join m on m.pair_id = n.pair_id and m.report_page = n.report_page and m.s_id = sa.region_id where not exists (select 1 from vec v where v.pair_id = n.pair_id and v.report_page = n.report_page)
        union all select t.pair_id, t.report_page, t.page, 'p' || t.page || '-untranslated-' || t.region_id, 'untranslated_text', case when l / a >= 0.9 then 'high' when l / a >= 0.7 then 'medium' else 'high' end, m.s_id, t.region_id, 'pair', 12, so.region_ord
            from (select *, {_script_count('text', 'latin')} as l, {_script_count('text', 'latin')} + {_script_count('text', 'cjk')} as a from tr) t join m on m.pair_id = t.pair_id and m.report_page = t.report_page and m.t_id = t.region_id join sr so on so.pair_id = m.pair_id and so.report_page = m.report_page and so.region_id = m.s_id
            join scripts p on p.pair_id = t.pair_id and p.report_page = t.report_page and p.side = 'source' left join scripts q on q.pair_id = t.pair_id and q.report_page = t.report_page and q.side = 'target'
            where t.type in {_TEXTS} and coalesce(t.text, '') <> '' and p.script = 'latin' and (q.script is null or q.script <> p.script) and a >= 8 and a - {_ACRONYMS} >= 8 and l / a >= 0.7 and not exists (select 1 from vec v where v.pair_id = t.pair_id and v.report_page = t.report_page)""",
    "per_type": "select pair_id, report_page, kind, type, sum(case severity " + " ".join(f"when '{s}' then {v}" for s, v in DEDUCTIONS.items()) + " end) as off, max(severity = 'critical') as critical, max(severity = 'high') as high, count(*) as n from issues group by all",
    "page_scores": "select e.pair_id, e.report_page, e.kind, coalesce(n, 0)::bigint as issue_count, greatest(0.0::double, 100 - coalesce(off, 0)::double) as score, coalesce(critical, false) as critical, coalesce(high, false) as high from entries e left join (select pair_id, report_page, kind, sum(n) as n, sum(least(off, case type " + " ".join(f"when '{t}' then {v}" for t, v in CAPS.items()) + " end)) as off, max(critical) as critical, max(high) as high from per_type group by all) p using (pair_id, report_page, kind)",
    "results": "select pair_id, report_page, kind, issue_count, score, case when critical or score < 75 then 'fail' when high or score < 90 then 'review' else 'pass' end as status from page_scores",
    "doc_results": "select pair_id, avg(score) as score, case when max(status = 'fail') then 'fail' when max(status = 'review') then 'review' else 'pass' end as status, count(*) as page_count from results group by pair_id",
    "files": "select text, sha256(text) as file_id, min(doc_id) as first_doc from documents where text is not null group by text",
    "records": "select x.doc_id as record_id, a.file_id as source_file_id, b.file_id as target_file_id, 'doc' || x.doc_id as source_name, 'doc' || (x.doc_id + 1) as target_name, case x.doc_id % 4 when 0 then 'pass' when 1 then 'review' else 'fail' end as status, (x.doc_id * 37) % 100000 as score_milli, (x.doc_id * 7919) % 10007 as created_at from documents x join files a on a.text = x.text join documents y on y.doc_id = x.doc_id + 1 join files b on b.text = y.text",
    "compared_records": "select pair_id as record_id, a.file_id as source_file_id, b.file_id as target_file_id, 'doc' || pair_id as source_name, 'doc' || (pair_id + 1) as target_name, status, floor(score * 1000 + 0.5)::bigint as score_milli, (pair_id * 7919) % 10007 as created_at from doc_results join documents x on x.doc_id = pair_id join files a on a.text = x.text join documents y on y.doc_id = pair_id + 1 join files b on b.text = y.text",
    "samples": "select d.doc_id as sample_id, a.file_id as source_file_id, b.file_id as target_file_id, case when d.doc_id % 3 = 0 then 'archived' else 'active' end as status, (d.doc_id * 31) % 1009 as updated_at, case when d.doc_id % 4 = 0 then 'Sample ' else 'sample ' end || (d.doc_id % 500) as name from documents d join files a on a.text = d.text join documents e on e.doc_id = d.doc_id + 1 join files b on b.text = e.text",
    "decisions": "select pair_id, issue_id, case when (pair_id + length(issue_id)) % 2 = 0 then 'accepted' else 'rejected' end as decision, (pair_id * 13) % 101 as reviewed_at from issues where (pair_id * 3 + length(issue_id)) % 4 = 0",
    "near_pages": "select s.pair_id, s.page as s_page, t.page as t_page from (select distinct pair_id, page from spans where side = 'source') s join t_pages t on s.pair_id = t.pair_id and abs(s.page - t.page) <= 3",
    "page_scores_of": f"select n.pair_id, n.s_page, n.t_page, s.region_ord as so, t.region_ord as to_, (0.4::double * {_position('s', 't')} + 0.25::double * {_size('s', 't')} + 0.2::double * case when s.type = t.type then 1.0::double when s.type in {_TEXTS} and t.type in {_TEXTS} then 0.8::double else 0.0::double end) / (0.4::double + 0.25::double + 0.2::double) as score from near_pages n join regions s on s.side = 'source' and s.pair_id = n.pair_id and s.page = n.s_page join regions t on t.side = 'target' and t.pair_id = n.pair_id and t.page = n.t_page",
    "clear_lines": "select pair_id, i, i // 6 + 1 as page, i % 6 as k, pair_id % 4 as edit, cast(20 + 45 * ((i // 6 + 1) % 4) as double) as x0, cast(30 + 120 * (i % 6) + 20 * ((i // 6 + 1) % 3) as double) as y, cast(60 + 10 * ((i * 7) % 9) as double) as w0, case when i % 3 <> 0 then 10.0::double else 90.0::double end as gap, case when pair_id % 4 = 1 then i // 6 when pair_id % 4 = 2 then i // 6 + 2 else i // 6 + 1 end as to_page, pair_id % 4 = 0 and i % 7 = 5 and i % 3 <> 0 as raster from lines",
    "clear_parts": "select *, 0 as part, x0 as x, case when i % 3 = 0 then w0 else w0 + gap + 40 end as width, case when i % 3 = 0 then 'label ' || i else 'label ' || i || chr(10) || 'value' end as text from clear_lines union all select *, 1, x0 + w0 + gap, 40.0::double, 'value' from clear_lines where i % 3 = 0",
    "clear_all": """select pair_id, 'source' as side, page, i, k, part, x, y, width, 20.0::double as height, 'paragraph' as type, text from clear_parts
        union all select pair_id, 'target', to_page, i, k, part, x + 3, y, width, 20.0::double, 'paragraph', text from clear_parts where not (edit = 1 and page = 1) and not (edit = 3 and k = 5)
        union all select pair_id, 'target', page, i, 100 + k, 0, x0 + 3, y, w0 + 50, 20.0::double, 'image', null from clear_lines where raster
        union all select pair_id, 'target', 1, -1, 0, 0, 200.0::double, 400.0::double, 90.0::double, 25.0::double, 'paragraph', 'front' from clear_lines where edit = 2 and i = 0""",
    "clear_regions": "select *, 'p' || page || '-r' || k || case when part > 0 then '-c' || (part + 1) else '' end as region_id, row_number() over (partition by pair_id, side, page order by y, x, k, part) - 1 as region_ord from clear_all",
    "clear_entries": """select distinct pair_id, page as s_page, case when edit = 1 and page = 1 then null else to_page end as t_page from clear_lines
        union all select distinct pair_id, null, 1 from clear_lines where edit = 2""",
    "clear_matches": "select s.pair_id, s.page as report_page, t.page as t_page, s.region_id as s_id, t.region_id as t_id, s.i, s.part, s.x as sx, s.y as sy, s.width as sw, t.x as tx, t.y as ty from clear_regions s join clear_regions t on s.pair_id = t.pair_id and s.side = 'source' and t.side = 'target' and s.i = t.i and s.part = t.part and t.type <> 'image'",
}


def sql(body: str) -> str:
    """The statement with the common tables it uses."""
    import re

    need: set[str] = set()
    todo = [body]
    while todo:
        for name in set(re.findall(r"\b[a-z_]+\b", todo.pop())) & set(CTES) - need:
            need.add(name)
            todo.append(CTES[name])
    # tables that others read more than once are made once
    used = " ".join([body, *[CTES[name] for name in need]])
    once = {name for name in need if len(re.findall(rf"\b{name}\b", used)) > 1}
    parts = [f"{name} as {'materialized ' if name in once else ''}({CTES[name]})" for name in CTES if name in need]
    if parts and body.startswith("with "):
        return f"with {', '.join(parts)}, {body.removeprefix('with ')}"
    return (f"with {', '.join(parts)} " if parts else "") + body


def _of(kinds: str) -> str:
    return f"select pair_id, report_page, page, issue_id, type, severity, s_id as source_region, t_id as target_region from issues where type in ({kinds}) and kind = 'pair'"


_E6 = "cast(floor({0} * 1000000 + 0.5) as bigint)"
_SPAN = "pair_id, i, page, slot, type, x, y, width, height, font_size, opacity, color, text"
BODIES = {
    "spans_source": f"select {_SPAN} from src",
    "spans_target": f"select pair_id, i, page, slot, type, x, y, width, height, font_size, opacity, color, text from tgt",
    "page_background": "select pair_id, side, page, 500.0::double as width, 800.0::double as height, '#FFFFFF' as background_color, count(*) filter (where type = 'image') as dark_boxes from spans group by all",
    "page_median_font": "select pair_id, side, page, median_font from fonts",
    "regions_fastpath": "select pair_id, side, page, region_id, type, x, y, width, height, font_size, text, region_ord::int as region_ord from regions",
    "region_neighbors": "select pair_id, side, page, region_id, lag(region_id) over w as above, lead(region_id) over w as below from regions window w as (partition by pair_id, side, page order by region_ord)",
    "integrity_violations": """with broken as (select pair_id, side, page, ord, case when pair_id % 11 = 3 and page = 1 then 0 else width end as width from spans where not (pair_id % 5 = 4 and ord = 1 and side = 'target')), again as (select * from broken union all select * from broken where pair_id % 7 = 0 and ord = 0),
        paper as (select distinct pair_id, side, page from spans where not (pair_id % 13 = 5 and page = 2)), kids as (select * from regions union all select * from regions where pair_id % 23 = 4 and region_ord = 0)
        select rule, n from (select 'size' as rule, count(*) as n from again where width <= 0 union all select 'block_twice', count(*) from broken where pair_id % 7 = 0 and ord = 0 union all select 'region_twice', count(*) from regions where pair_id % 23 = 4 and region_ord = 0
        union all select 'page_size', sum(case when pair_id % 17 = 1 then 2 else 1 end)::bigint from paper where pair_id % 19 = 2 union all select 'page_twice', count(*) from paper where pair_id % 17 = 1 union all select 'no_page', count(*) from again where pair_id % 13 = 5 and page = 2
        union all select 'unknown_child', count(*) from kids where pair_id % 5 = 4 and side = 'target' and region_id = 'p' || page || '-r1') where n > 0""",
    "page_pairs_identity": "select coalesce(s.pair_id, t.pair_id) as pair_id, s.page as s_page, t.page as t_page from s_pages s full join t_pages t on s.pair_id = t.pair_id and s.page = t.page",
    "page_entries": "select pair_id, s_page, t_page, report_page, kind from entries",
    "score_matrix": f"select s.pair_id, s.report_page, s.region_id as s_region_id, t.region_id as t_region_id, {_E6.format('(' + _position('s', 't') + ')')} as position_e6, {_E6.format(_size('s', 't'))} as size_e6, case when s.type = t.type then 100 when s.type in {_TEXTS} and t.type in {_TEXTS} then 80 else 0 end as type_pct, {_E6.format('(1 - abs(s.region_ord / greatest(1, s.n - 1) - t.region_ord / greatest(1, t.n - 1)))')} as order_e6 from sr s join tr t on s.pair_id = t.pair_id and s.report_page = t.report_page",
    "unmatched_regions": "select pair_id, report_page, side, region_id from alone_s union all select pair_id, report_page, side, region_id from alone_t",
    "structured_diff": f"select pair_id, report_page, s_id as s_region_id, t_id as t_region_id, {_E6.format('dx')} as dx_e6, {_E6.format('dy')} as dy_e6, {_E6.format('dw')} as dw_e6, {_E6.format('dh')} as dh_e6, {_E6.format('fc')} as font_e6, color_changed from d",
    "layout_analog": "select pair_id, report_page, t_ord::int as t_region_ord, a_ord::int as a_region_ord from analog",
    "overlap_pairs": f"select pair_id, report_page, a_id as first_region, b_id as second_region, {_E6.format('ratio')} as ratio_e6, with_image from laps",
    "covered_text": f"select s.pair_id, s.report_page, s.region_id from sr s where s.type <> 'image' and (s.region_ord % 6 = 0 or not exists (select 1 from m where m.pair_id = s.pair_id and m.report_page = s.report_page and m.s_id = s.region_id)) and exists (select 1 from tr o where o.pair_id = s.pair_id and o.report_page = s.report_page and o.type in {_TEXTS} and {_overlap('s', 'o')} >= 0.4)",
    "region_styles": "select pair_id, side, page, region_id, opacity, case when color is null then 0 else 1 end as n_colors, color as first_color from regions",
    "page_similarity": f"""select n.pair_id, n.s_page, n.t_page, {_E6.format('((f.v / greatest(sn.n, tn.n) + b.v / greatest(sn.n, tn.n)) / 2)')} as similarity_e6 from near_pages n
        join (select pair_id, page, count(*) as n from spans where side = 'source' group by all) sn on sn.pair_id = n.pair_id and sn.page = n.s_page join (select pair_id, page, count(*) as n from spans where side = 'target' group by all) tn on tn.pair_id = n.pair_id and tn.page = n.t_page
        join (select pair_id, s_page, t_page, sum(best) as v from (select pair_id, s_page, t_page, so, max(score) as best from page_scores_of group by all) group by all) f on f.pair_id = n.pair_id and f.s_page = n.s_page and f.t_page = n.t_page
        join (select pair_id, s_page, t_page, sum(best) as v from (select pair_id, s_page, t_page, to_, max(score) as best from page_scores_of group by all) group by all) b on b.pair_id = n.pair_id and b.s_page = n.s_page and b.t_page = n.t_page""",
    "regions_components": "select pair_id, side, page, region_id, type, x, y, width, height, text, region_ord::int as region_ord from clear_regions",
    "page_alignment": "select pair_id, s_page, t_page, coalesce(s_page, t_page) as report_page, case when t_page is null then 'missing' when s_page is null then 'extra' else 'pair' end as kind from clear_entries",
    "match_full": f"select pair_id, report_page, s_id as s_region_id, t_id as t_region_id, 100 as type_pct, {_E6.format('(1 - sqrt((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy)) / sqrt(890000.0::double))')} as position_e6, 1000000 as size_e6 from clear_matches",
    "issue_rasterized": "select m.pair_id, m.report_page, m.t_page as page, 'p' || m.t_page || '-rasterized-' || i.region_id as issue_id, 'text_rasterized' as type, 'high' as severity, m.s_id as source_region, i.region_id as target_region from clear_matches m join clear_regions i on i.pair_id = m.pair_id and i.side = 'target' and i.type = 'image' and i.i = m.i",
    "issue_alignment": "select pair_id, page as report_page, page, 'p' || page || '-alignment-p' || page || '-r0-p' || page || '-r' || (n - 1) as issue_id, 'text_alignment_changed' as type, 'high' as severity, 'p' || page || '-r0' as source_region, 'p' || page || '-r0' as target_region from (select pair_id, i // 10 + 1 as page, count(*) as n from lines where pair_id % 3 <> 0 group by all) where n >= 3",
    "issue_glossary": " union all ".join(
        f"select d.pair_id, d.report_page, d.t_page as page, 'p' || d.t_page || '-glossary-' || d.t_id || '-{term}' as issue_id, 'glossary_violation' as type, 'high' as severity, d.s_id as source_region, d.t_id as target_region from d where regexp_matches(d.s_text, '{flag}(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') and d.t_text <> '' and not ({' or '.join(f"contains(d.t_text, '{a}')" for a in allowed)}) and not exists (select 1 from vec v where v.pair_id = d.pair_id and v.report_page = d.report_page)"
        for term, flag, allowed in (("The", "(?i)", "的"), ("und", "", "和与"), ("la", "", "这"))
    ),
    "profile_versions": """with own as (select i.pair_id, i.report_page, i.kind, i.issue_id, i.type, case when i.pair_id % 3 = 1 and i.type = 'region_shifted' then case when greatest(abs(d.dx), abs(d.dy)) > 0.17 then 'high' else 'medium' end when i.pair_id % 3 = 1 and i.type = 'font_shrink' then case when abs(d.fc) >= 0.4 then 'low' else 'info' end else i.severity end as severity
            from issues i left join d on d.pair_id = i.pair_id and d.report_page = i.report_page and d.t_id = i.t_id and d.s_id = i.s_id
            left join scripts p on p.pair_id = i.pair_id and p.report_page = i.report_page and p.side = 'source' left join scripts q on q.pair_id = i.pair_id and q.report_page = i.report_page and q.side = 'target'
            where not (i.pair_id % 3 = 1 and (i.type in ('typography_changed', 'text_overlap', 'text_image_overlap') or (i.type = 'region_shifted' and greatest(abs(d.dx), abs(d.dy)) <= 0.13)))
            and not (i.pair_id % 3 = 2 and i.type = 'number_mismatch' and coalesce(p.script = 'latin' and q.script = 'cjk', false))),
        typed as (select pair_id, report_page, kind, type, sum(case severity """ + " ".join(f"when '{s}' then {v}" for s, v in DEDUCTIONS.items()) + """ end) as off, max(severity = 'critical') as critical, max(severity = 'high') as high, count(*) as n, string_agg(issue_id || ':' || type || ':' || severity, ',') as ids from own group by all),
        paged as (select pair_id, report_page, kind, sum(n) as n, sum(least(off, case when pair_id % 3 = 2 and type = 'font_shrink' then 4.0 else case type """ + " ".join(f"when '{t}' then {v}" for t, v in CAPS.items()) + """ end end)) as off, max(critical) as critical, max(high) as high, array_to_string(list_sort(string_split(string_agg(ids, ','), ',')), ',') as issues from typed group by all)
        select e.pair_id, e.report_page, e.kind, coalesce(n, 0)::bigint as issue_count, greatest(0.0::double, 100 - coalesce(off, 0)::double) as score, issues,
            case when coalesce(critical, false) or greatest(0, 100 - coalesce(off, 0)) < 75 then 'fail' when (e.pair_id % 3 <> 2 and coalesce(high, false)) or greatest(0, 100 - coalesce(off, 0)) < 90 then 'review' else 'pass' end as status
        from entries e left join paged using (pair_id, report_page, kind)""",
    "match_tangled": "select pair_id, i // 6 + 1 as report_page, 'p' || (i // 6 + 1) || '-r' || (i % 6) as s_region_id, 'p' || (i // 6 + 1) || '-r' || (i % 6) as t_region_id from lines",
    "claims_shared": "select pair_id, page as report_page, page, 'p' || page || '-rasterized-p' || page || '-r' || (k * 4 + 2 + s) as issue_id, 'text_rasterized' as type, 'high' as severity, 'p' || page || '-r' || (k * 4 + s) as source_region, 'p' || page || '-r' || (k * 4 + 2 + s) as target_region from (select pair_id, i // 8 + 1 as page, i % 8 as k from lines), (values (0), (1)) v(s)",
    "alignment_columns": "select pair_id, page as report_page, page, 'p' || page || '-alignment-p' || page || '-r0-p' || page || '-r' || last as issue_id, 'text_alignment_changed' as type, 'high' as severity, 'p' || page || '-r0' as source_region, 'p' || page || '-r0' as target_region from (select pair_id, i // 20 + 1 as page, count(*) as n, max(i % 20) as last from lines where pair_id % 2 = 1 and i % 2 = 0 group by all) where n >= 3",
    "alignment_gaps": """with of_source as (select distinct pair_id, i // 6 + 1 as page, pair_id % 3 as edit from lines), ends as (select pair_id, max(page) as last from of_source group by pair_id),
        paired as (select pair_id, page as s_page, case when edit = 0 and page = 2 then null when edit = 0 then page - case when page > 2 then 1 else 0 end else page + case when page > 2 then 1 else 0 end + case when edit = 2 and page > 4 then 1 else 0 end end as t_page from of_source
            union all select pair_id, null, 3 from ends where pair_id % 3 > 0 and last >= 3 union all select pair_id, null, 6 from ends where pair_id % 3 = 2 and last >= 5)
        select pair_id, s_page, t_page, coalesce(s_page, t_page) as report_page, case when t_page is null then 'missing' when s_page is null then 'extra' else 'pair' end as kind from paired""",
    "stage_contents": f"""with kinds as (select pair_id, side, type, count(*) as n from regions group by all), sided as (select k.pair_id, k.side, k.side || ':' || any_value(p.pages) || ':' || cast(sum(n) as bigint) || ':' || string_agg(type || '=' || n, ',' order by type) as told from kinds k join (select pair_id, side, count(distinct page) as pages from regions group by all) p on p.pair_id = k.pair_id and p.side = k.side group by k.pair_id, k.side),
        scored as (select m.pair_id, m.report_page, count(*) as n, avg(0.4::double * {_position('s', 't')} + 0.25::double * {_size('s', 't')} + 0.2::double * case when s.type = t.type then 1.0::double when s.type in {_TEXTS} and t.type in {_TEXTS} then 0.8::double else 0.0::double end + 0.15::double * (1 - abs(s.region_ord / greatest(1, s.n - 1) - t.region_ord / greatest(1, t.n - 1)))) as score
            from m join sr s on s.pair_id = m.pair_id and s.report_page = m.report_page and s.i = m.i join tr t on t.pair_id = m.pair_id and t.report_page = m.report_page and t.i = m.i group by all),
        lost as (select pair_id, report_page, string_agg(region_id, ',' order by region_ord) as ids from alone_s group by all), got as (select pair_id, report_page, string_agg(region_id, ',' order by region_ord) as ids from alone_t group by all),
        paged as (select e.pair_id, e.s_page, e.t_page, e.s_page || '-' || e.t_page || ':' || coalesce(c.n, 0) || ':' || coalesce(l.ids, '') || ':' || coalesce(g.ids, '') || ':' || coalesce(cast(cast(floor(c.score * 1000000 + 0.5) as bigint) as varchar), '') as told from entries e left join scored c on c.pair_id = e.pair_id and c.report_page = e.report_page left join lost l on l.pair_id = e.pair_id and l.report_page = e.report_page left join got g on g.pair_id = e.pair_id and g.report_page = e.report_page where e.kind = 'pair')
        select d.pair_id, 'group' as stage, coalesce(s.told, 'source:0:0:') || ' ' || coalesce(t.told, 'target:0:0:') as told from (select distinct pair_id from regions) d left join sided s on s.pair_id = d.pair_id and s.side = 'source' left join sided t on t.pair_id = d.pair_id and t.side = 'target'
        union all select pair_id, 'alignment', coalesce(string_agg(s_page || '-' || t_page, ',' order by s_page, t_page) filter (where kind = 'pair'), '') || '|' || coalesce(string_agg(s_page::varchar, ',' order by s_page) filter (where kind = 'missing'), '') || '|' || coalesce(string_agg(t_page::varchar, ',' order by t_page) filter (where kind = 'extra'), '') from entries group by pair_id
        union all select pair_id, 'match', string_agg(told, ' ' order by s_page, t_page) from paged group by pair_id
        union all select pair_id, 'detect', cast(sum(n) as bigint) || ':' || string_agg(type || '=' || n, ',' order by type) from (select pair_id, type, count(*) as n from issues group by all) group by pair_id""",
    "record_commits": """select doc_id as record_id, case when doc_id % 3 = 0 then 'again' else 'new' end as status, sha256(text) as source_file_id, (doc_id * 37) % 1000 + case when doc_id % 3 = 0 then 1000 else 0 end as score_milli, len(string_split(text, chr(10))) as pages,
        case when doc_id % 4 = 0 then 'g' || (doc_id % 5) || case when doc_id % 3 = 0 then '@1000' else '@0' end end as glossary from documents where text is not null and (doc_id % 2 = 0 or doc_id % 3 = 0) and doc_id % 11 <> 0""",
    "issue_metrics": _told(),
    "document_report": "select r.pair_id, r.status, r.page_count, floor(r.score * 1000 + 0.5)::bigint as score_milli, p.pass_pages, p.review_pages, p.fail_pages, " + ", ".join(f"coalesce(i.{s}, 0) as {s}" for s in DEDUCTIONS) + ", coalesce(i.issue_total, 0) as issue_total from doc_results r join (select pair_id, count(*) filter (where status = 'pass') as pass_pages, count(*) filter (where status = 'review') as review_pages, count(*) filter (where status = 'fail') as fail_pages from results group by pair_id) p on p.pair_id = r.pair_id left join (select pair_id, " + ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in DEDUCTIONS) + ", count(*) as issue_total from issues group by pair_id) i on i.pair_id = r.pair_id",
    "top_issues": "select pair_id, place::int as place, report_page, issue_id, type, severity from (select *, row_number() over (partition by pair_id order by report_page, det, ro, issue_id) as place from issues) where place <= 10",
    "bbox_groups": "select pair_id, page, floor(x + 0.5)::bigint as x, floor(y + 0.5)::bigint as y, floor(width + 0.5)::bigint as width, floor(height + 0.5)::bigint as height, count(*) as n, string_agg(issue_id, ',' order by issue_id) as issue_ids from (select i.pair_id, i.page, i.issue_id, coalesce(t.x, s.x) as x, coalesce(t.y, s.y) as y, coalesce(t.width, s.width) as width, coalesce(t.height, s.height) as height from issues i left join tr t on t.pair_id = i.pair_id and t.report_page = i.report_page and t.region_id = i.t_id left join sr s on i.type in ('missing_image', 'missing_element') and s.pair_id = i.pair_id and s.report_page = i.report_page and s.region_id = i.s_id) where x is not null group by 1, 2, 3, 4, 5, 6",
    "nested_reports": "select r.pair_id, r.status, 'translation-balanced@1' as profile_reference, r.page_count as pages, sha256(coalesce(i.ids, '')) as issues_sha256 from doc_results r left join (select pair_id, string_agg(issue_id, ',' order by report_page, case kind when 'pair' then 0 when 'missing' then 1 else 2 end, det, ro, issue_id) as ids from issues group by pair_id) i on i.pair_id = r.pair_id",
    "history_page": "select record_id from records order by created_at desc, record_id desc limit 8 offset 16",
    "glossary_upsert": """with rows_ as (select 'g' || (doc_id % 40) as glossary_id, doc_id % 7 as version, 'n' || (doc_id % 11) as name, doc_id % 3 as part, doc_id % 13 as entry_count from documents), one as (select glossary_id, version, part, max(name) as name, max(entry_count) as entry_count from rows_ group by all),
        gone as (select glossary_id, version from one where part = 2 and version = 3)
        select glossary_id, version, coalesce(n.name, o.name) as name, coalesce(n.entry_count, o.entry_count) as entry_count, case when g.version is null then 'active' else 'archived' end as status, case when o.version is null then 2 else 1 end as created_at, case when g.version is not null then 3 when n.version is not null then 2 else 1 end as updated_at
        from (select * from one where part = 0) o full join (select * from one where part = 1) n using (glossary_id, version) left join gone g using (glossary_id, version)""",
    "sample_create": """select sample_id, name, case when sample_id % 5 = 0 and sample_id % 10 <> 0 then 'archived' else status end as status, case when sample_id % 10 = 0 then 'builtin' else 'user' end as origin from (select sample_id, name, status from samples where sample_id % 3 = 0
        union all select sample_id, name, status from (select *, row_number() over (partition by lower(name) order by sample_id) as nth from samples where sample_id % 3 = 1 and source_file_id <> target_file_id and lower(name) not in (select lower(name) from samples where sample_id % 3 = 0)) where nth = 1)""",
    "schema_descriptions": """select * from (values ('documents', 'doc_id', 'bigint', null), ('documents', 'lang', 'string', null), ('documents', 'n_chars', 'bigint', null), ('documents', 'source', 'string', null), ('documents', 'text', 'string', null),
        ('files', 'file_id', 'string', 'digest of the content'), ('files', 'first_doc', 'bigint', 'smallest document with the content'), ('files', 'text', 'string', 'content'),
        ('records', 'created_at', 'bigint', 'place in time'), ('records', 'record_id', 'bigint', 'comparison'), ('records', 'score_milli', 'bigint', 'score in thousandths'), ('records', 'source_file_id', 'string', 'source content'), ('records', 'source_name', 'string', null), ('records', 'status', 'string', 'verdict'), ('records', 'target_file_id', 'string', 'target content'), ('records', 'target_name', 'string', null),
        ('samples', 'name', 'string', 'unique whatever its case'), ('samples', 'sample_id', 'bigint', 'sample'), ('samples', 'source_file_id', 'string', 'source content'), ('samples', 'status', 'string', 'active or archived'), ('samples', 'target_file_id', 'string', 'target content'), ('samples', 'updated_at', 'bigint', 'last change')) v(table_name, column_name, data_type, description)
        where exists (select 1 from documents)""",
    "main_scripts": _main_scripts(),
    "issue_filters": "select i.pair_id, i.report_page, i.issue_id, i.type from issues i left join decisions d on d.pair_id = i.pair_id and d.issue_id = i.issue_id where d.issue_id is null and i.report_page = 1 and i.type in ('region_shifted', 'font_shrink', 'added_element')",
    "evict_cascade": "select doc_id % 700 as record_id, doc_id as event_id from documents where doc_id % 700 in (select record_id from records qualify row_number() over (order by created_at desc, record_id desc) <= 100)",
    "profile_defaults": "select doc_id, case when doc_id % 2 = 0 then doc_id % 7 else 5 end as minimum_tenths, 75 as fail_score, case when doc_id % 3 = 0 then doc_id % 5 + 1 else 10 end as font_cap, 12 as shift_cap, 25 as n_caps from documents",
    "uploads": "select sha256('%PDF-' || text) as sha256, any_value(strlen(text) + 5) as length from documents where text is not null and doc_id % 3 <> 0 and strlen(text) + 5 <= 2000 group by 1",
    "profiles_selectable": "select * from (select source as profile_id, doc_id as version, case doc_id % 3 when 0 then 'draft' when 1 then 'published' else 'archived' end as status, case when doc_id % 2 = 0 then 'builtin' else 'user' end as origin from documents) where status = 'published' or (status <> 'archived' and origin <> 'builtin')",
    "glossary_by_reference": "select doc_id from documents where doc_id % 40 = 3 and doc_id % 7 = 2",
    "valid_ids": "select doc_id, source || case doc_id % 4 when 1 then 'é_' else '-x' end as id from documents where doc_id % 4 in (1, 3) and source is not null",
    "flow_suppression": """select pair_id, report_page, report_page as page, 'p' || report_page || '-shift-p' || report_page || '-r' || k as issue_id, 'region_shifted' as type, case when abs(dx) > 0.15 then 'high' else 'medium' end as severity, 'p' || report_page || '-r' || k as source_region, 'p' || report_page || '-r' || k as target_region from (
        select pair_id, i // 10 + 1 as report_page, i % 10 as k, (case when pair_id % 3 = 1 then 440 - (100 + 13 * ((i * 5) % 11)) else 250 - (100 + 13 * ((i * 5) % 11)) / 2 end - 60) / 500 as dx, count(*) over (partition by pair_id, i // 10) as n from lines where pair_id % 3 <> 0) where n < 3 and abs(dx) > 0.05""",
    "scan_blocks": """select pair_id, row_number() over (partition by pair_id order by i, s)::int - 1 as block_ord, block_id, type, x, y, width, height, font_size, color, text, i::int as source_block_index, opacity_milli, weight, italic, case when s >= 0 then 'f' end as font_family, case when s >= 0 then 0 end as source_line_index, case when s >= 0 then s end as source_span_index, case when s < 0 then 'block-' || i || case when i % 4 = 1 then '.png' else '.bin' end end as asset_ref, case when s < 0 then 5 end as pixel_width, case when s < 0 then 4 end as pixel_height, case when s < 0 and i % 4 = 1 then 'png' end as extension from (
        select pair_id, i, s, 'p1-b' || i || '-l0-s' || s as block_id, 'text' as type, cast(10 + 100 * s as double) as x, cast(20 * i as double) as y, cast((pair_id * 3 + i) % 4 * 10 as double) as width, 10.0::double as height, case when (pair_id + i) % 3 > 0 then cast((pair_id + i) % 3 * 6 as double) end as font_size, '#' || printf('%06X', (pair_id * 65793) % 16777216) as color, 't' || i || '.' || s as text,
            case when (pair_id + i) % 7 <> 6 then cast(floor(least(1.0::double, ((pair_id + i) % 3 * 130) / 255.0::double) * 1000 + 0.5) as bigint) end as opacity_milli, case when (i % 4) * 8 & 16 > 0 then 700 else 400 end as weight, (i % 4) * 8 & 2 > 0 as italic
            from lines, (values (0), (1)) v(s) where (pair_id + i) % 5 <> 0 and (pair_id * 3 + i) % 4 > 0
        union all select pair_id, i, -1, 'p1-b' || i || '-image', 'image', 10.0::double, cast(20 * i as double), 50.0::double, 10.0::double, null, null, null, null, null, false from lines where (pair_id + i) % 5 = 0 and i % 2 = 1)""",
    "scan_pages": """select pair_id, case when light and 800 - 100 * (pair_id % 6) > 500 then own when light and 800 - 100 * (pair_id % 6) = 500 then own else '#FAFAFA' end as background_color, images + (case when not light and not small then 1 else 0 end) + (case when wide then 1 else 0 end) as dark_boxes,
        image_area + (case when not light and not small then 500 * (800 - 100 * (pair_id % 6)) else 0 end) + (case when wide then 50 * (pair_id % 11) * 100 else 0 end) as dark_area from (
        select pair_id, '#' || printf('%02X', pair_id * 7 % 64 + 192) || printf('%02X', pair_id * 11 % 64 + 192) || printf('%02X', pair_id * 13 % 64 + 192) as own, least(pair_id * 7 % 64, pair_id * 11 % 64, pair_id * 13 % 64) + 192 >= 0.92::double * 255 and 800 - 100 * (pair_id % 6) >= 400 as light, least(pair_id * 7 % 64, pair_id * 11 % 64, pair_id * 13 % 64) + 192 >= 0.92::double * 255 as small,
            50 * (pair_id % 11) * 100 >= 40000 as wide, count(*) filter (where (pair_id + i) % 5 = 0) as images, coalesce(sum(case when (pair_id + i) % 5 = 0 then 50 * 10 * (i % 2) end), 0)::bigint as image_area from lines group by pair_id)""",
    "issue_page_missing": "select pair_id, report_page, issue_id, severity from issues where type = 'page_missing'",
    "issue_extra_page": "select pair_id, report_page, issue_id, severity from issues where kind = 'extra'",
    "issue_missing": _of("'missing_image', 'missing_element'"),
    "issue_added": _of("'added_element'"),
    "issue_shift": _of("'region_shifted'"),
    "issue_font_shrink": _of("'font_shrink'"),
    "issue_font_grow": _of("'typography_changed'"),
    "issue_resized": _of("'region_resized'"),
    "issue_fragmented": _of("'text_fragmented'"),
    "issue_invisible": _of("'invisible_text'"),
    "issue_out_of_page": _of("'content_out_of_page'"),
    "issue_overlap": _of("'text_overlap'"),
    "issue_text_image": _of("'text_image_overlap'"),
    "issue_vectorized": _of("'text_vectorized'"),
    "issue_numbers": _of("'number_mismatch'"),
    "issue_untranslated": _of("'untranslated_text'"),
    "dominant_script": "select pair_id, report_page, side, script from scripts",
    "page_score": "select pair_id, report_page, kind, issue_count, score, status from results",
    "document_score": "select pair_id, status, page_count, floor(score * 1000 + 0.5)::bigint as score_milli from doc_results",
    "severity_counts": "select pair_id, " + ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in DEDUCTIONS) + ", count(*) as issue_total from issues group by pair_id",
    "status_counts": "select status, count(*) as pages from results group by status",
    "issue_types": "select pair_id, type, count(*) as n from issues group by all",
    "problem_pages": "select pair_id, report_page, kind, status from results where status <> 'pass'",
    "distinct_types": "select distinct type from issues",
    "stage_summary": "select pair_id, 'parse' as stage, count(*) as n from spans group by pair_id union all select pair_id, 'group', count(*) from regions group by pair_id union all select pair_id, 'alignment', count(*) from entries group by pair_id union all select pair_id, 'match', count(*) from m group by pair_id union all select pair_id, 'detect', count(*) from issues group by pair_id",
    "issue_filter_review": "select i.pair_id, i.issue_id, i.severity, case when d.issue_id is null then 'pending' else 'done' end as review from issues i left join decisions d on d.pair_id = i.pair_id and d.issue_id = i.issue_id where i.severity in ('critical', 'high')",
    "related_issues": "select a.pair_id, a.report_page, a.issue_id, count(*) as related from issues a join issues b on a.pair_id = b.pair_id and a.report_page = b.report_page and a.kind = b.kind and a.s_id is not distinct from b.s_id and a.t_id is not distinct from b.t_id and a.issue_id <> b.issue_id group by all",
    "ui_rollup": "select i.pair_id, count(*) filter (where severity in ('critical', 'high')) as severe, count(*) filter (where severity not in ('critical', 'high')) as general, count(d.issue_id) as reviewed, cast(floor(100 * count(d.issue_id) / count(*) + 0.5) as bigint) as reviewed_percent from issues i left join (select distinct pair_id, issue_id from decisions) d on d.pair_id = i.pair_id and d.issue_id = i.issue_id group by i.pair_id",
    "stored_files": "select file_id, first_doc from files",
    "history_list": "select record_id, source_file_id, target_file_id, status, score_milli, created_at from records",
    "history_search": "select record_id, status from compared_records where status = 'fail' and (contains(lower(source_name), '7') or contains(lower(target_name), '7'))",
    "history_search_index": "select record_id, status from records where contains(lower(source_name), 'oc7') or contains(lower(target_name), 'oc7')",
    "history_evict": "select record_id from records qualify row_number() over (order by created_at desc, record_id desc) <= 100",
    "sample_autolink": "select record_id, arg_max(sample_id, (updated_at, sample_id)) as sample_id from records r join samples s on r.source_file_id = s.source_file_id and r.target_file_id = s.target_file_id and s.status = 'active' group by record_id",
    "samples_active": "select sample_id, name from samples where status = 'active'",
    "sample_unique_name": "select lower(name) as name, count(*) as n from samples group by 1 having count(*) > 1",
    "review_upsert": "select pair_id, issue_id, decision, reviewed_at from (select pair_id, issue_id, decision, reviewed_at from decisions where reviewed_at % 3 <> 0 union all select pair_id, issue_id, 'revised', reviewed_at + 1000 from decisions where reviewed_at % 3 = 0)",
    "next_version": "select lang as family, max(doc_id % 97) + 1 as version from documents group by lang",
    "number_tokens": f"select doc_id, unnest({_NUMBERS}) as number from documents",
    "digit_normalize": f"select doc_id, sha256(translate(text, '{DIGITS_FROM}', '{DIGITS_TO}')) as digest from documents where text is not null",
    "bcp47_normalize": "select doc_id, lang || '-' || case doc_id % 3 when 0 then 'Latn' when 1 then 'GB' else 'x1' end as tag from documents",
    "band_severity": "select doc_id, " + ", ".join(f"case when (doc_id % 100) / {m} >= {hi} then 'high' when (doc_id % 100) / {m} >= {lo} then 'medium' else 'high' end as {b}" for b, m, hi, lo in (("number_mismatch_bands", "10.0::double", 5, 1), ("font_shrink_bands", "100.0::double", 0.4, 0.2), ("untranslated_bands", "100.0::double", 0.9, 0.7), ("region_resize_bands", "100.0::double", 0.8, 0.5))) + " from documents",
    "profile_publish": "select source as profile_id, doc_id as version, case when doc_id % 3 = 0 then case when source = 'src3' then 'published' else 'draft' end when doc_id % 3 = 1 then 'published' else 'archived' end as status from documents",
    "legacy_import": "select lang || '-' || (doc_id % 50) as import_key, case when max(doc_id % 3 = 0) then 'old' else 'new' end as origin from documents group by 1",
    "language_backfill": "select doc_id as record_id, case when doc_id % 2 = 1 then 'fr' when doc_id % 3 = 0 then 'en' when doc_id % 3 = 1 then 'zh' end as source_language from documents",
    "flow_inference": """select pair_id, report_page, lines, first_region, last_region, case when lines >= 3 and s1 <= 0.015 and s2 - s1 >= 0.01 then n1 end as alignment, left_e6, right_e6, center_e6 from (
        select *, list_sort([{'s': l, 'n': 'left'}, {'s': r, 'n': 'right'}, {'s': c, 'n': 'center'}]) as o, o[1].s as s1, o[2].s as s2, o[1].n as n1, cast(floor(l * 1000000 + 0.5) as bigint) as left_e6, cast(floor(r * 1000000 + 0.5) as bigint) as right_e6, cast(floor(c * 1000000 + 0.5) as bigint) as center_e6 from (
        select pair_id, page as report_page, count(*) as lines, 'r' || arg_min(i, (y, x, i)) as first_region, 'r' || arg_max(i, (y, x, i)) as last_region, (max(x) - min(x)) / 500 as l, (max(x + width) - min(x + width)) / 500 as r, (max(x + width / 2) - min(x + width / 2)) / 500 as c from src where type = 'text' group by pair_id, page))""",
    "builtin_pairs": "select a.source as source_name, b.source as target_name from (select distinct source from documents) a join (select distinct 'translated_' || source as source from documents) b on b.source = 'translated_' || a.source",
}

ORACLE_SQL = {name: sql(body) for name, body in BODIES.items()}
