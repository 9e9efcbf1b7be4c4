"""DuckDB's SQL for the queries of this package, over the given tables."""

from __future__ import annotations

from ..operators.search import STOCK
from ..sources.dims import BANDS, DESCRIPTION, FOUNDED, OPTIONS, OTHER_COLOUR, OWNER_COLOUR, OWNERSHIP, PRODUCTS, QUALITY_COLOUR, REVENUE, SIZE, TAXONOMY, VERTICALS
from ..sources.standins import RECORDS_PER_REPLY, SEGMENTS, TYPES


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def pick(values: list[str], at: str) -> str:
    return f"{array(values)}[(({at}) % {len(values)} + 1)::int]"


def band(attribute: str, value: str) -> str:
    def inside(lo, hi):
        return " and ".join([f"{value} >= {lo}"] * (lo is not None) + [f"{value} < {hi}"] * (hi is not None))

    return "case " + " ".join(f"when {inside(lo, hi)} then {quoted(label)}" for label, (lo, hi) in BANDS[attribute].items()) + " end"


COMPANY = f"""
    bought as (
        select o_custkey, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as total, min(year(o_orderdate)) as y from orders group by o_custkey
    ), kinds as (
        select o_custkey, list_sort((list(value order by q desc, value) filter (kind = 'type'))[1:2]) as verticals, list_sort((list(value order by q desc, value) filter (kind = 'brand'))[1:6]) as tags
        from (select o_custkey, kind, value, sum(l_quantity) as q from (
            select o_custkey, unnest(['type', 'brand']) as kind, unnest([p_type, p_brand]) as value, l_quantity from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
        ) group by all) group by o_custkey
    ), company as (
        select 'run-' || (c_custkey % 15) as run_id, c_custkey::int as id, c_name as name, case when c_custkey % 7 <> 0 then 'https://v' || c_custkey || '.example' end as website,
            n_name as country, (y + c_custkey % 30)::int as founded_year, n * 50 as n_employees, (total * 20)::decimal(20,2) as revenue_usd,
            {band("size", "n * 50")} as employees, {band("revenue", "total * 20")} as revenue, c_mktsegment as ownership, concat_ws(', ', 'Port', n_name) as hq,
            coalesce(verticals, []) as verticals, [{pick(PRODUCTS, "c_custkey")}] as products, coalesce(tags, []) as tags,
            'Vendor in ' || coalesce(n_name, 'nowhere') as description, c_acctbal / 100 as score, {band("size", "n * 50")} as size, {band("founded", "(y + c_custkey % 30)")} as founded
        from customer left join nation on c_nationkey = n_nationkey left join bought on bought.o_custkey = c_custkey left join kinds on kinds.o_custkey = c_custkey
    )"""


def _chosen(every: int, labels: list[str]) -> str:
    return f"case when s_suppkey % {every} = 0 then {pick(labels[1:], 's_suppkey')} else {quoted(labels[0])} end"


BRIEF = f"""
    brief as (
        select 'b' || s_suppkey as brief_id, {pick(PRODUCTS, "s_suppkey")} as product,
            case when s_suppkey % 3 = 0 then ['Brand#' || (s_suppkey % 25 + 1), 'Brand#' || (s_suppkey * 3 % 25 + 1)] when s_suppkey % 3 = 1 then ['Brand#' || (s_suppkey % 25 + 1)] else []::varchar[] end as first_tags,
            case when s_suppkey % 3 = 0 then ['Brand#' || (s_suppkey * 7 % 25 + 1)] else []::varchar[] end as second_tags,
            case when s_suppkey % 4 = 0 then [{pick(TYPES, "s_suppkey")}, {pick(TYPES, "s_suppkey + 1")}] else []::varchar[] end as verticals,
            case when s_suppkey % 5 = 0 then {pick(SEGMENTS, "s_suppkey")} else {quoted(OWNERSHIP[0])} end as ownership,
            {_chosen(7, REVENUE)} as revenue, {_chosen(6, SIZE)} as size, {_chosen(9, FOUNDED)} as founded
        from supplier
    ), briefs as (select *, list_concat(first_tags, second_tags) as tags from brief)"""

MATCHED = f"""
    with {COMPANY}, {BRIEF}, matched as (
        select brief_id, c.*, len(list_intersect(list_distinct(b.tags), c.tags)) as tag_hits from company c join briefs b on list_contains(c.products, b.product)
        where (len(b.verticals) = 0 or list_has_any(c.verticals, b.verticals)) and (len(first_tags) = 0 or list_has_any(c.tags, first_tags))
            and (len(second_tags) = 0 or list_has_any(c.tags, second_tags)) and (b.ownership = {quoted(OWNERSHIP[0])} or c.ownership = b.ownership)
            and (b.revenue = {quoted(REVENUE[0])} or c.revenue = b.revenue) and (b.size = {quoted(SIZE[0])} or c.size = b.size)
            and (b.founded = {quoted(FOUNDED[0])} or c.founded = b.founded)
    )"""


def facet(condition: str) -> str:
    return f"with {COMPANY}, {BRIEF} select brief_id, count(*) as n_companies from company c join briefs b on {condition} group by brief_id"


def _stock(key: str, listed: str) -> str:
    return f"coalesce(nullif(array_to_string({listed}, ', '), ''), {quoted(STOCK[key])})"


def _phrase(column: str) -> str:
    return f"case when {column} = {quoted(OPTIONS[column][0])} then {quoted(STOCK[column])} else {column} end"


_RUN = f"(c_custkey // {RECORDS_PER_REPLY})"
# The customers whose records a sound reply holds, with their position; a leading null record moves it by one.
RECORDS = f"""
    base as (
        select c.*, {_RUN} as run, c_custkey as c, 'reply-' || {_RUN} as run_id, row_number() over (partition by {_RUN} order by c_custkey) + case when {_RUN} % 16 = 7 then 1 else 0 end as id,
            {pick(PRODUCTS, _RUN)} as product from customer c
    ), kept as (select * from base where run % 16 in (0, 1, 7, 15))"""
OUTCOME = "case when run % 16 in (0, 7, 15) then 'parsed' when run % 16 = 1 then 'repaired' when run % 16 in (2, 3, 8, 14) then 'unparseable' when run % 16 = 4 then 'no_array' when run % 16 = 5 then 'empty' else 'request_failed' end"
_FAILED = "run % 16 in (6, 9, 10, 11, 12, 13)"
_VERTICALS = "case c % 5 when 0 then 'Metals & Mining,Bulk Liquids' when 1 then 'Mining' when 4 then 'x,' else '' end"
_SCORE = "case c % 4 when 0 then floor(c_acctbal / 100) when 1 then 91.5 else 75.0 end"
_NAME = "case when c % 13 = 0 then '' else c_name end"
_PRODUCTS = "case c % 3 when 0 then product else product end"

OUTCOMES = f"""
    with runs as (select distinct {_RUN} as run from customer), {RECORDS}
    select 'reply-' || run as run_id, {OUTCOME} as outcome, case when {_FAILED} then 0 else run % 4 end as n_calls, case when run % 16 = 7 then 1 else 0 end as n_rejected,
        coalesce(n, 0) as n_found, coalesce(n90, 0) as n_shown, not {_FAILED} and coalesce(n90, 0) = 0 as shows_nothing
    from runs left join (select run, count(*) as n, count(*) filter ({_SCORE} >= 90) as n90 from kept group by run) using (run)"""

NORMALISED = f"""
    with {RECORDS}
    select run_id, id, {_NAME} as name, case when c % 5 = 1 then 'v' || c when c % 5 <> 0 then 'https://v' || c || '.example' end as website,
        case c % 3 when 0 then 'US' when 1 then 'USA' end as country, case when c % 4 = 2 then c % 30 + 1990 end as founded_year,
        case c % 3 when 0 then '11–50' when 1 then 'many' end as employees, case when c % 2 = 0 then 'VC-Backed' else c_mktsegment end as ownership,
        {_VERTICALS} as verticals, product as products, case when c % 3 = 0 then 'api' else '' end as tags, {_SCORE} as score
    from kept"""

EVENT = "e as (select *, regexp_extract(props, '[0-9]+')::int as k from events)"
_FACET_ROWS = ", ".join(
    f"({i}, {array([g for g, tags in groups.items() for _ in tags])}, {array([t for tags in groups.values() for t in tags])})" for i, groups in enumerate(TAXONOMY.values())
)
_ATTRS = list(OPTIONS)[:4]
SELECTION = f"""
    with {EVENT}, facets(product_ord, grps, tags) as (values {_FACET_ROWS}), ev as (
        select event_id, (ts, event_id) as at_, user_id::varchar as session_id,
            case event_type when 'click' then 'toggle_vertical' when 'view' then 'toggle_tag' when 'purchase' then 'set_attr' when 'signup' then 'set_product'
                when 'error' then case when k % 2 = 0 then 'clear_all' else 'clear_verticals' end end as op,
            case event_type when 'view' then grps[k % len(grps) + 1] when 'purchase' then {pick(_ATTRS, "k")} end as grp,
            case event_type when 'click' then {pick(VERTICALS, "k")} when 'view' then tags[k % len(tags) + 1] when 'signup' then {pick(PRODUCTS, "k")}
                when 'purchase' then case k % 4 {" ".join(f"when {i} then {pick(OPTIONS[a], 'event_id')}" for i, a in enumerate(_ATTRS))} end end as value
        from e join facets on product_ord = user_id % 15
    ), marks as (
        select session_id, max(at_) filter (op = 'clear_all') as all_at, max(at_) filter (op in ('clear_all', 'clear_verticals')) as v_at, max(at_) filter (op in ('clear_all', 'set_product')) as t_at,
            arg_max(value, at_) filter (op = 'set_product') as product, {", ".join(f"arg_max(value, at_) filter (op = 'set_attr' and grp = '{a}') as {a}, max(at_) filter (op = 'set_attr' and grp = '{a}') as {a}_at" for a in _ATTRS)}
        from ev group by session_id
    ), live as (
        select ev.*, min(at_) over (partition by session_id, op, grp) as grp_at from ev join marks using (session_id)
        where (op = 'toggle_vertical' and (v_at is null or at_ > v_at)) or (op = 'toggle_tag' and (t_at is null or at_ > t_at))
    ), on_ as (
        select session_id, op, grp, value, grp_at, max(at_) as at_ from live group by all having count(*) % 2 = 1
    ), lists as (
        select session_id, string_agg(value, '|' order by at_) filter (op = 'toggle_vertical') as verticals, string_agg(grp || ':' || value, '|' order by grp_at, at_) filter (op = 'toggle_tag') as tags
        from on_ group by session_id
    ), briefs as (
        select session_id as brief_id, product, coalesce(tags, '') as tags, coalesce(verticals, '') as verticals,
            {", ".join(f"case when {a}_at is not null and (all_at is null or {a}_at > all_at) then {a} else {quoted(OPTIONS[a][0])} end as {a}" for a in _ATTRS)}
        from marks left join lists using (session_id)
    )"""

_FIELDS = {"role": "click", "comments": "view", "quality": "purchase"}
SHORTLIST = f"""
    {EVENT}, ev as (
        select (ts, event_id) as at_, 'list-' || (event_id % 3) as list_id, 'run-' || (user_id % 15) as run_id, user_id::int as id, event_type,
            case event_type when 'click' then 'role ' || k when 'view' then 'note ' || event_id when 'purchase' then {pick(OPTIONS["quality"], "k")} end as value from e
    ), folded as (
        select list_id, run_id, id, max(at_) filter (event_type = 'signup') as saved_at, max(at_) filter (event_type = 'error') as unsaved_at,
            {", ".join(f"max(at_) filter (event_type = '{t}') as {f}_at, arg_max(value, at_) filter (event_type = '{t}') as {f}_value" for f, t in _FIELDS.items())}
        from ev group by list_id, run_id, id
    ), shortlist as (
        select list_id, run_id, id, saved_at is not null and (unsaved_at is null or saved_at > unsaved_at) as saved, '' as website, '' as contact_name, '' as email,
            {", ".join(f"case when {f}_at is not null and (saved_at is null or {f}_at > saved_at) then {f}_value else {quoted('—' if f == 'quality' else '')} end as {f}" for f in _FIELDS)}
        from folded
    ), saved as (
        select c.*, s.list_id, s.role as m_role, s.comments as m_comments, s.quality as m_quality from company c join shortlist s using (run_id, id) where s.saved
    )"""
_SHEET = """
    select list_id, run_id, id, coalesce(website, '') as "Website", name as "Company", array_to_string(verticals, ', ') as "Vertical", coalesce(country, '') as "Country",
        coalesce(nullif(founded_year, 0)::varchar, '') as "Year Founded", coalesce(employees, '') as "Employees", case when m_quality = '—' then '' else m_quality end as "Quality",
        coalesce(revenue, '') as "Est. Revenue", description as "Overview", coalesce(ownership, '') as "Ownership", '' as "Contact Name", m_role as "Role", '' as "Email", m_comments as "Comments"
    from saved"""
TEXT_QUERIES = {"de": "DE", "src1": "src1", "the": " the ", "accent": "É", "literal": "a%r"}

ORACLE_SQL: dict[str, str] = {
    "company_profile": f"with {COMPANY} select * exclude (verticals, products, tags), array_to_string(verticals, '|') as verticals, array_to_string(products, '|') as products, array_to_string(tags, '|') as tags from company",
    "text_filter": f"""
        with q(query_id, q) as (values {", ".join(f"({quoted(i)}, {quoted(q)})" for i, q in TEXT_QUERIES.items())})
        select query_id, doc_id from q, documents where contains(lower(coalesce(source, '')), lower(q)) or contains(lower(coalesce(text, '')), lower(q)) or contains(lower(coalesce(lang, '')), lower(q))""",
    "text_filters_indexed": """
        with f as (select doc_id as query_id, lower(substr(text, 21, 12)) as q from documents where text is not null)
        select query_id, doc_id from f join documents on contains(lower(coalesce(source, '')), q) or contains(lower(coalesce(text, '')), q) or contains(lower(coalesce(lang, '')), q)""",
    "rank_overall": "select 'run-' || (c_custkey % 15) as run_id, c_custkey::int as id, c_acctbal / 100 as score, row_number() over (order by c_acctbal / 100 desc, 'run-' || (c_custkey % 15), c_custkey) as rank from customer",
    "rank_by_score": "select 'run-' || (c_custkey % 15) as run_id, c_custkey::int as id, c_acctbal / 100 as score, row_number() over (partition by c_custkey % 15 order by c_acctbal / 100 desc, c_custkey) as rank from customer",
    "score_band": "select case when c_acctbal / 100 >= 90 then 'A' when c_acctbal / 100 >= 80 then 'B' when c_acctbal / 100 >= 70 then 'C' else 'D' end as band, count(*) as n_companies from customer group by 1",
    "facet_product": facet("list_contains(c.products, b.product)"),
    "facet_vertical": facet("list_contains(c.products, b.product) and (len(b.verticals) = 0 or list_has_any(c.verticals, b.verticals))"),
    "facet_tags": facet("list_contains(c.products, b.product) and (len(first_tags) = 0 or list_has_any(c.tags, first_tags)) and (len(second_tags) = 0 or list_has_any(c.tags, second_tags))"),
    **{f"facet_{a}": facet(f"list_contains(c.products, b.product) and (b.{a} = {quoted(OPTIONS[a][0])} or c.{a} = b.{a})") for a in _ATTRS},
    "brief_match": f"{MATCHED} select brief_id, run_id, id, name, score, tag_hits, row_number() over (partition by brief_id order by score desc, run_id, id) as rank from matched",
    "band_labels": f"""
        with {COMPANY}, n(attribute, number, run_id, id) as (select 'revenue', revenue_usd::double, run_id, id from company union all select 'size', n_employees::double, run_id, id from company
            union all select 'founded', founded_year::double, run_id, id from company)
        select run_id, id, attribute, number, case attribute {" ".join(f"when {quoted(a)} then {band(a, 'number')}" for a in BANDS)} end as label from n""",
    "band_join": """
        with bands as (select s_suppkey, s_nationkey, case when s_suppkey % 10 <> 0 then s_acctbal::double end as lo,
            case when s_suppkey % 7 <> 0 then s_acctbal::double + case when s_suppkey % 4 = 0 then -1.0 else s_suppkey % 5 * 100.0 end end as hi from supplier)
        select s_suppkey, c_custkey from bands join customer on c_nationkey = s_nationkey and (lo is null or c_acctbal >= lo) and (hi is null or c_acctbal < hi) where lo is null or hi is null or lo < hi""",
    "product_description": f"""
        with {BRIEF} select brief_id, product, case product {" ".join(f"when {quoted(p)} then {quoted(d)}" for p, d in DESCRIPTION.items())} end as description from briefs""",
    "brief_filter_count": f"""
        {SELECTION} select brief_id, case when tags = '' then 0 else len(string_split(tags, '|')) end + case when verticals = '' then 0 else len(string_split(verticals, '|')) end
            + {" + ".join(f"({a} <> {quoted(OPTIONS[a][0])})::int" for a in _ATTRS)} as n_filters, case when verticals = '' then 0 else len(string_split(verticals, '|')) end as n_verticals,
            n_filters || case when n_filters > 1 then ' filters active' else ' filter active' end as filters_text from briefs""",
    "brief_text": f"""
        with {BRIEF} select brief_id, concat_ws('; ', product, {_stock("verticals", "verticals")}, {_stock("tags", "tags")}, {", ".join(map(_phrase, _ATTRS))}) as brief from briefs""",
    "brief_chips": f"""
        with {BRIEF} select brief_id, array_to_string(list_concat([product], verticals, tags, list_filter([case when ownership <> {quoted(OWNERSHIP[0])} then ownership end,
            case when revenue <> {quoted(REVENUE[0])} then revenue end, case when size <> {quoted(SIZE[0])} then size || ' emp' end], lambda x: x is not null)), '|') as chips from briefs""",
    "option_flags": f"""
        with {BRIEF}, options(attribute, ord, label) as (values {", ".join(f"({quoted(a)}, {i}, {quoted(x)})" for a in _ATTRS for i, x in enumerate(OPTIONS[a]))}),
        chosen as (select unnest({array(_ATTRS)}) as attribute, unnest([{", ".join(_ATTRS)}]) as label from briefs)
        select attribute, ord, label, count(chosen.label) as n_briefs from options left join chosen using (attribute, label) group by attribute, ord, label""",
    "facet_use": f"""
        {SELECTION}, used as (select product, unnest(string_split(tags, '|')) as t from briefs where tags <> '')
        select t as facet, count(*) as n_briefs from used group by t""",
    "vertical_flags": f"""
        {SELECTION}, v(ord, option) as (values {", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(VERTICALS))})
        select option, ord, count(*) filter (list_contains(string_split(verticals, '|'), option)) as n_selected, count(*) as n_briefs from briefs, v group by option, ord""",
    "reply_text": """
        select conv_id, coalesce(string_agg(coalesce(text, ''), chr(10) order by turn) filter (role = 'assistant'), '') as reply from conversations group by conv_id""",
    "reply_call_count": "select conv_id, count(*) filter (role = 'system') as n_calls from conversations group by conv_id",
    "reply_records": f"with {RECORDS} select run_id, id, {_NAME} as name, product from kept",
    "reply_outcomes": OUTCOMES,
    "outcome_counts": f"with o as ({OUTCOMES}) select outcome, count(*) as n_runs, sum(n_calls)::bigint as n_calls, sum(n_found)::bigint as n_found from o group by outcome",
    "reply_quarantine": f"with runs as (select distinct {_RUN} as run from customer) select 'reply-' || run as run_id, 0 as pos, 'not an object: VOID' as reason from runs where run % 16 = 7",
    "reply_raw": f"""
        with {RECORDS} select run_id, id, (c % 20)::int as raw_id, case c % 4 when 0 then floor(c_acctbal / 100)::bigint::varchar when 1 then '91.5' when 2 then '85' end as raw_score,
            (6 + (c % 5 <> 0)::int + (c % 4 <> 3)::int + (c % 5 <> 3)::int + (c % 3 <> 2)::int + (c % 4 <> 3)::int)::int as n_keys from kept""",
    "owner_colour": f"""
        with {RECORDS}, o as (select run_id, id, case when c % 2 = 0 then 'VC-Backed' else c_mktsegment end as ownership from kept)
        select *, case ownership {" ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in OWNER_COLOUR.items())} else {quoted(OTHER_COLOUR)} end as colour from o""",
    "quality_colour": f"""
        with {COMPANY}, {SHORTLIST} select list_id, run_id, id, quality,
            case quality {" ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in QUALITY_COLOUR.items())} end as colour from shortlist""",
    "normalise_records": NORMALISED,
    "props_field": "select event_type, count(*) as n, sum(regexp_extract(props, '[0-9]+')::int)::bigint as total, max(regexp_extract(props, '[0-9]+')::int) as most from events group by event_type",
    "selection_state": f"{SELECTION} select * from briefs",
    "shortlist_state": f"with {COMPANY}, {SHORTLIST} select * from shortlist",
    "shortlist_view": f"with {COMPANY}, {SHORTLIST} select list_id, run_id, id, name, score, m_role as role, m_comments as comments, m_quality as quality from saved",
    "shortlist_flags": f"with {COMPANY}, {SHORTLIST} select run_id, id, exists (select 1 from shortlist s where s.saved and s.run_id = c.run_id and s.id = c.id) as is_saved from company c",
    "shortlist_export": f"with {COMPANY}, {SHORTLIST} {_SHEET}",
    "shortlist_header": f"""
        with {COMPANY}, {SHORTLIST} select list_id, run_id, id, concat_ws(' | ', name, ownership, hq, 'Est. ' || founded_year, employees || ' emp', revenue) as header from saved""",
    "shortlist_counts": f"""
        with {COMPANY}, {SHORTLIST} select s.list_id, count(*) filter (saved) as n_saved, count(*) filter (saved and c.id is not null) as n_in_view, n_saved || case when n_saved = 1 then ' company' else ' companies' end as saved_text
        from shortlist s left join (select run_id, id from company) c on c.run_id = s.run_id and c.id = s.id group by s.list_id""",
    "detail_card": f"""
        with {COMPANY} select run_id, id, case when id % 3 = 0 then '—' else coalesce(founded_year::varchar, '—') end as founded, case when id % 8 = 0 then '—' when id % 4 = 0 then '0' else hq end as hq,
            coalesce(country, '—') as country, coalesce(employees, '—') as employees, coalesce(revenue, '—') as revenue from company""",
    "contract_audit": f"""
        with {RECORDS}, n as (select count(*) as n from kept), runs as (select run, count(*) + case when run % 16 = 7 then 1 else 0 end as n from kept group by run),
        ids as (select run, c % 20 as i, count(*) as n from kept group by all), broken(rule, b) as (
            select 'C1 name', count(*) filter (c % 13 = 0) from kept union all select 'C2 website', count(*) filter (c % 5 in (0, 1)) from kept
            union all select 'C3 country', count(*) filter (c % 3 <> 0) from kept union all select 'C4 founded', count(*) filter (c % 4 = 1) from kept
            union all select 'C5 employees', count(*) filter (c % 3 = 1) from kept union all select 'C5 revenue', 0
            union all select 'C6 ownership', count(*) filter (c % 2 <> 0) from kept union all select 'C7 verticals', count(*) filter (c % 5 = 4) from kept
            union all select 'C8 products', count(*) filter (c % 3 <> 0) from kept
            union all select 'C9 score', count(*) filter (c % 4 <> 0 or floor(c_acctbal / 100) not between 1 and 100) from kept
        )
        select rule, n.n as n_checked, b as n_broken from broken, n
        union all select 'C10 ids', count(*), count(*) filter (n > 1) from ids union all select 'C11 size', count(*), count(*) filter (n < 20) from runs""",
    "export_roundtrip": f"with {COMPANY}, {SHORTLIST}, s as ({_SHEET}) select * exclude (list_id, run_id, id) from s",
}
ORACLE_SQL["raw_paths"] = f"with r as ({ORACLE_SQL['reply_raw']}) select * exclude (n_keys) from r"
ORACLE_SQL["ingest_audit"] = ORACLE_SQL["contract_audit"]
ORACLE_SQL["brief_match_indexed"] = ORACLE_SQL["brief_match"]
ORACLE_SQL |= {
    "stream_ingest": NORMALISED.replace("select run_id, id,", "select run_id, id, (c % 20)::int as raw_id,"),
    "stream_quarantine": ORACLE_SQL["reply_quarantine"],
    "stream_outcomes": f"with o as ({OUTCOMES}) select run_id, outcome, n_calls, n_rejected from o",
    "stream_landed_json": f"with o as ({OUTCOMES}) select run_id, outcome, n_calls, n_found, n_rejected from o",
    "stream_shortlist": ORACLE_SQL["shortlist_state"],
    "stream_shortlist_retained": ORACLE_SQL["shortlist_state"],
    "stream_selection": ORACLE_SQL["selection_state"],
    "stream_counters": ORACLE_SQL["outcome_counts"],
}
