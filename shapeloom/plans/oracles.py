"""The same results in SQL over the same tables, built with a different JSON engine.

Collections are put together from the tables again, opened with recursive queries or
``json_tree``, and aggregated. Nothing here is shared with the Spark jobs but the texts of the
derived collections.
"""

from __future__ import annotations

from shapeloom.functions.json_text import BOM
from shapeloom.operators.propose import BAD_PATH
from shapeloom.operators.render import SCHEMA_URI
from shapeloom.plans import corpora
from shapeloom.plans.queries import SAMPLE_BYTES, SUBSET_BYTES

_INT_DIV = f"event_id // {corpora.EVENT_CHUNK}"

_EVENTS_PROPS = "select event_type as dataset, event_id as doc_id, props as json from events"

_MIXED = """select 'm' || (event_id % 3) as dataset, event_id as doc_id,
    case when event_id % 7 = 0 then '{"a":null,"z":true}'
         when event_id % 5 = 0 then '{"a":' || event_id || '}'
         when event_id % 5 = 1 then '{"a":' || event_id || '.5}'
         when event_id % 5 = 2 then '{"a":"' || event_type || '"}'
         when event_id % 5 = 3 then '{"a":[' || event_id || ',"x",{"q":[]}]}'
         else '{"a":{"b":' || event_id || '},"l":[]}' end as json
    from events"""

_ORDERS = """select o_orderpriority as dataset, o_orderkey as doc_id,
    '{"person":{"id":' || c_custkey || ',"name":"' || c_name || '"'
      || case when c_acctbal >= 0 then ',"email":"c' || c_custkey || '@example.org"' else '' end
      || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"},"products":' || products
      || ',"transaction":{"id":' || o_orderkey || ',"person_id":' || o_custkey
      || ',"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","status":"' || o_orderstatus
      || '","total":' || o_totalprice || '},"transaction_items":' || items || '}' as json
    from orders join customer on o_custkey = c_custkey
    join (
        select l_orderkey,
            '[' || string_agg('{"id":' || l_linenumber || ',"transaction_id":' || l_orderkey
                || ',"product_id":' || l_partkey || ',"quantity":' || l_quantity::int
                || ',"price":' || l_extendedprice || '}', ','
                order by l_linenumber, l_partkey, l_quantity::int, l_extendedprice) || ']' as items,
            '[' || string_agg('{"id":' || p_partkey || ',"name":"' || p_name || '","category":"'
                || p_type || '","price":' || p_retailprice || ',"in_stock":' || (p_size > 10)
                || ',"brand":"' || p_brand || '"}', ','
                order by l_linenumber, l_partkey, l_quantity::int, l_extendedprice) || ']' as products
        from lineitem join part on l_partkey = p_partkey group by l_orderkey
    ) on o_orderkey = l_orderkey"""


def _labelled(absent: str) -> str:
    return f"""select lang as dataset, doc_id, '{{"id":' || doc_id || ',"source":"' || source
        || '","n_chars":' || n_chars || ',"labels":{{' || {absent} || '}}}}' as json
        from documents left join labels using (doc_id)"""


_SPARSE = _labelled(
    """case when quality is null and toxic is null then ''
            when toxic is null then '"quality":' || quality
            when quality is null then '"toxic":' || toxic
            else '"quality":' || quality || ',"toxic":' || toxic end"""
)
_NULLABLE = _labelled(
    """'"quality":' || coalesce(quality::varchar, 'null') || ',"toxic":' || coalesce(toxic::varchar, 'null')"""
)
_VECTORS = """select label::varchar as dataset, vec_id as doc_id,
    '{"v":' || to_json(embedding)::varchar || '}' as json from embeddings"""

# Keys of these collections hold none of . [ ~ so paths can be read off the engine's own.
_KIND = """case t.type when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer'
    when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' else lower(t.type) end"""


def _nodes(docs: str, keys: str = "dataset, doc_id") -> str:
    return f"""select {keys},
        replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g'), '$', '') as path,
        1 + length(regexp_replace(t.fullkey, '[^.\\[]', '', 'g')) as depth, {_KIND} as kind
        from (select *, json::json as j from ({docs})), json_tree(j) t"""


_TYPES = """array_to_string(list_sort(list_filter(list_distinct(list(kind)), lambda k:
    not (k = 'integer' and list_contains(list_distinct(list(kind)), 'number')))), '|')"""


def _paths(docs: str, keys: str = "dataset") -> str:
    by = ", ".join(f"c.{k.strip()} = p.{k.strip()}" for k in keys.split(",")).replace(", ", " and ")
    out = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""with nodes as ({_nodes(docs, keys)}),
    kinds as (select distinct {keys}, path, kind from nodes),
    counts as (select {keys}, path, count(*) as nodes, count(*) filter (kind = 'object') as objects,
        regexp_replace(path, '(\\.[^.\\[]*|\\[\\])$', '') as parent from nodes group by all),
    types as (select {keys}, path, string_agg(kind, '|' order by kind) as types from kinds k
        where not (kind = 'integer' and exists (select 1 from kinds n where n.path = k.path
            and n.kind = 'number' and {" and ".join(f"n.{x.strip()} = k.{x.strip()}" for x in keys.split(","))}))
        group by {keys}, path)
    select {out}, c.path, c.nodes, t.types,
        coalesce(c.path <> '' and not ends_with(c.path, '[]') and c.nodes = p.objects, false) as required
    from counts c join types t on t.path = c.path
        and {" and ".join(f"t.{x.strip()} = c.{x.strip()}" for x in keys.split(","))}
    left join counts p on p.path = c.parent and c.path <> '' and {by}"""


# --- manifest -----------------------------------------------------------------------------

_MANIFEST = f"""select {corpora.FILE_SQL} as file, 'documents' as object_type,
    {corpora.COMPLEXITY_SQL} as complexity, '1' as keys, '2' as depth, '0' as arrays,
    '0' as array_len, length(props)::varchar as size_bytes, {corpora.FLAG_SQL} as schema_generated
    from events"""
_DATASET = "nullif(split_part(file, '/', 2), '')"
# A flag that is missing counts as false; one read from an empty CSV field is not missing.
_REFRESH = f"""select m.file, m.schema_generated as old,
    lower(trim(coalesce(schema_generated, '%s'))) = 'false' and e.event_id is not null as updated
    from ({_MANIFEST}) m left join events e
        on e.event_id % 3 <> 0 and {_DATASET} = e.event_type
        and split_part(file, '/', 4) = 'document_' || e.event_id || '.json'"""
_REFRESHED, _REFRESHED_FILE = (_REFRESH.replace("%s", default) for default in ("false", ""))

# --- files --------------------------------------------------------------------------------

_ELEMENTS = f"""select event_type, {_INT_DIV} as chunk, event_id,
    {corpora.ARRAY_ELEMENT_SQL} as e from events"""
_FILES = f"""select 'collection=' || event_type || '-' || chunk as dataset, event_type, chunk,
    string_agg(e, ', ' order by event_id) as elements from ({_ELEMENTS}) group by all"""
_FORMATS = f"""select dataset, case when event_type = 'view' and chunk % 4 = 1 then 'lines'
    when event_type = 'view' and chunk % 4 = 2 then 'unknown'
    when event_type = 'view' and chunk % 4 = 3 then 'empty' else 'array' end as format,
    event_type = 'error' and chunk % 2 = 1 as broken, chunk, event_type, elements from ({_FILES})"""

# --- proposals ----------------------------------------------------------------------------

_PROPOSALS = f"""select event_type as dataset, event_id::varchar as file, {corpora.PROPOSAL_SQL} as text
    from (select *, {corpora.VALUE_NODE_SQL} as value_node, {corpora.META_NODE_SQL} as meta_node
          from events)"""
_BLOCK = "regexp_extract(text, '(?s)\\{.*\\}', 0)"
_PARSED = f"""select dataset, file,
    case when json_valid(ltrim(text, '{BOM}')) then text::json
         when {_BLOCK} <> '' and json_valid({_BLOCK}) then {_BLOCK}::json end as j,
    case when json_valid(ltrim(text, '{BOM}')) then 'ok'
         when {_BLOCK} <> '' and json_valid({_BLOCK}) then 'sliced' else 'failed' end as status
    from ({_PROPOSALS})"""

_MARKERS = """['title', 'description', 'default', 'pattern', 'format', 'minimum', 'maximum',
    'minLength', 'maxLength']"""


def _member(node: str, key: str) -> str:
    return f"json_extract({node}, '$.\"' || {key} || '\"')"


def _moves(node: str, key: str) -> str:
    value = _member(node, key)
    return f"({key} <> 'required' and json_type({value}) = 'OBJECT' and json_exists({value}, '$.type'))"


def _schema_walk(files: str) -> str:
    """Recursive walk of repaired schema documents; common table expressions up to ``facts``."""
    looked = f"""list_filter(case when json_type(node) = 'OBJECT' and not has_properties
            then json_keys(node) else [] end, lambda k: {_moves('node', 'k')})"""
    node_facts = f"""select *,
        case when has_properties then false
             else len(moved) > 0 and (coalesce(type_kind = 'VARCHAR' and type_text = 'object', false)
                or len(list_filter({_MARKERS}, lambda m: json_exists(node, '$.' || m)
                    and not list_contains(moved, m))) > 0) end as forced
        from (select *, {looked} as moved from (
            select *, coalesce(json_type(node, '$.properties') = 'OBJECT', false) as has_properties,
                json_type(node, '$.type') as type_kind, node->>'$.type' as type_text,
                json_type(node, '$.required') as required_kind
            from (%s)))"""
    visited = """(voted and case when depth = 1 then true
        when forced then not list_contains(moved, 'type')
        else json_exists(node, '$.properties') and (
            coalesce(type_kind = 'VARCHAR' and type_text = 'object', false)
            or (coalesce(type_kind = 'ARRAY', false)
                and list_contains(from_json(node->'$.type', '["json"]'), '"object"'::json))) end)"""
    return f"""walk as (
        select dataset, file, status, '' as path, 1 as depth, j as node, true as voted,
            false as is_required from ({files}) where j is not null
        union all
        select n.dataset, n.file, n.status, n.path || '.' || e.key, n.depth + 1, e.value, n.visited,
            coalesce(n.required_kind = 'ARRAY', false)
                and list_contains(from_json(n.node->'$.required', '["json"]'), to_json(e.key))
        from (select *, {visited} as visited from ({node_facts % 'select * from walk'})) n,
            json_each(case when n.has_properties then n.node->'$.properties'
                           when n.forced then n.node else '{{}}'::json end) e
        where json_type(e.value) = 'OBJECT'
            and (n.has_properties or list_contains(n.moved, e.key))
    ),
    facts as (
        select *, visited and ((depth = 1 and json_type(node) <> 'OBJECT')
            or (not has_properties and not forced and json_exists(node, '$.properties'))
            or (coalesce(required_kind = 'ARRAY', false) and len(list_filter(
                from_json(node->'$.required', '["json"]'),
                lambda r: json_type(r) in ('OBJECT', 'ARRAY'))) > 0)) as bad,
            case when forced and list_contains(moved, 'type') then ['null']
                 when forced then ['object']
                 when type_kind is null or type_kind = 'NULL' then ['null']
                 when type_kind = 'VARCHAR' then [type_text]
                 when type_kind = 'ARRAY' then list_transform(
                    list_filter(from_json(node->'$.type', '["json"]'), lambda t: json_type(t) <> 'NULL'),
                    lambda t: t->>'$')
                 else [] end as types,
            case when type_kind is null then 'absent' when type_kind = 'VARCHAR' then 'string'
                 else lower(type_kind) end as type_form,
            case when required_kind is null then 'absent' when required_kind = 'VARCHAR' then 'string'
                 else lower(required_kind) end as required_form
        from (select *, {visited} as visited from ({node_facts % 'select * from walk'}))
    )"""


_WALK = f"with recursive {_schema_walk(_PARSED)}"


def _votes_of(walk: str) -> str:
    return f"""{walk},
    rejected as (select distinct dataset, file from facts where bad),
    votes as (select dataset, file, path, types, type_form, is_required from facts
        where voted and depth > 1
            and not exists (select 1 from rejected r where r.dataset = facts.dataset and r.file = facts.file)),
    stats as (select dataset, path, count(*) as appearances,
        count(*) filter (is_required) as required_count from votes group by all),
    type_votes as (select dataset, path, type, count(*) as votes
        from (select dataset, path, unnest(types) as type from votes) group by all),
    named as (select dataset, path, sum(votes) filter (type <> 'null') as total,
        max(votes) filter (type <> 'null') as top,
        arg_max(type, votes) filter (type <> 'null') as leader,
        list_sort(list(type) filter (type <> 'null')) as all_types,
        bool_or(type = 'null') as has_null from type_votes group by all),
    resolved as (select s.dataset, s.path,
        case when coalesce(n.total, 0) = 0 then ['null'] when top / total::double >= 0.75 then [leader]
             else all_types end as types,
        coalesce(has_null and total > 0, false) as nullable,
        required_count / appearances::double >= 0.6 as required
        from stats s left join named n using (dataset, path)),
    with_null as (select *, case when not nullable then types
        when len(types) > 1 then list_sort(list_append(types, 'null'))
        else list_append(types, 'null') end as final_types from resolved),
    kept as (select * from with_null w where not exists (select 1 from with_null a
        where a.dataset = w.dataset and starts_with(w.path, a.path || '.')
            and len(list_filter(a.final_types, lambda t: contains(t, 'object'))) = 0)),
    merged as (select dataset, path, case when exists (select 1 from kept c where c.dataset = k.dataset
            and starts_with(c.path, k.path || '.')) then ['object'] else final_types end as types,
        required from kept k)"""


_VOTES = _votes_of(_WALK)


def _joined(column: str) -> str:
    return f"array_to_string({column}, '|') as {column}"


# Per document, every path has one kind and every member is required: what a schema inferred
# from the document alone proposes. Arrays are not descended into by the vote.
_OFFLINE = f"""with nodes as ({_nodes(_SPARSE)}),
    per_doc as (select distinct dataset, doc_id, path, kind from nodes
        where path <> '' and not contains(path, '[]')),
    voted as (select dataset, path, kind as types, true as required from (
        select dataset, path, kind, count(*) over (partition by dataset, path) as kinds
        from (select distinct dataset, path, kind from per_doc)) where kinds = 1),
    inferred as ({_paths(_SPARSE).replace("with nodes as", "with inner_nodes as").replace("from nodes", "from inner_nodes")}),
    both_sides as (select coalesce(v.dataset, i.dataset) as dataset, coalesce(v.path, i.path) as path,
        v.types as left_types, i.types as right_types, v.required as left_required,
        i.required as right_required
        from voted v full outer join (select * from inferred where path <> '') i
            on v.dataset = i.dataset and v.path = i.path),
    diff as (select *, case when right_types is null then 'only_left'
        when left_types is null then 'only_right'
        when left_types <> right_types and left_required <> right_required
            then 'type_and_required_differ'
        when left_types <> right_types then 'type_differs'
        when left_required <> right_required then 'required_differs' else 'equal' end as outcome
        from both_sides)"""

_K_SCHEMA = (
    '{"$schema": "' + SCHEMA_URI + '", "type": "object", "properties": {"k": {"type": "integer"}}'
    ', "required": ["k"]}'
)


def _rendered(with_paths: str, head: str) -> str:
    """Text of a schema of up to three levels of members, from a table ``p`` of its paths."""

    def level(depth: int) -> str:
        below = f"left join (select dataset, parent, members, required_keys from agg{depth + 1}) c on c.dataset = n.dataset and c.parent = n.path" if depth < 3 else ""
        text = (
            """case when c.members is not null then '{"type": "object", "properties": {' || members || '}'
                || case when required_keys is null then '' else ', "required": [' || required_keys || ']' end
                || '}' else '{"type": ' || type_text || '}' end"""
            if depth < 3
            else """'{"type": ' || type_text || '}'"""
        )
        return f"""agg{depth} as (select dataset, parent, string_agg('"' || key || '": ' || text, ', ' order by key) as members,
            string_agg('"' || key || '"', ', ' order by key) filter (required) as required_keys
            from (select n.*, {text} as text from named_paths n {below} where n.depth = {depth})
            group by dataset, parent)"""

    return f"""{with_paths},
    named_paths as (select dataset, path, required, regexp_extract(path, '[^.]*$', 0) as key,
        regexp_replace(path, '\\.[^.]*$', '') as parent, len(string_split(path, '.')) - 1 as depth,
        case when contains(types, '|') then '["' || replace(types, '|', '", "') || '"]'
             else '"' || types || '"' end as type_text from p where path <> ''),
    {level(3)}, {level(2)}, {level(1)}
    select dataset, '{head}"type": "object", "properties": {{' || members || '}}'
        || case when required_keys is null then '' else ', "required": [' || required_keys || ']' end
        || '}}' as schema_json from agg1"""


def _prints(side: str) -> str:
    return f"""select t.dataset, t.path, string_agg(substr(b.path, length(t.path) + 1) || '=' || b.types
            || case when b.path = t.path then '' else b.required::varchar end, ';' order by b.path) as print
        from {side} t join {side} b on b.dataset = t.dataset
            and (b.path = t.path or starts_with(b.path, t.path || '.') or starts_with(b.path, t.path || '['))
        where t.path <> '' group by t.dataset, t.path"""


def _alone(outcome: str, prints: str) -> str:
    return f"""select d.dataset, d.path, p.print, regexp_extract(d.path, '(\\.[^.\\[]*)$', 1) as own,
        regexp_replace(d.path, '\\.[^.\\[]*$', '') as parent
        from diff d join ({prints}) p using (dataset, path) where d.outcome = '{outcome}'"""


def _met(by: str) -> str:
    """Paths on one side each that are the only ones with their print and ``by``."""
    one = "(select dataset, {0}, print, min(path) as path from {1} group by all having count(*) = 1)"
    return f"""select g.dataset, g.path, n.path as to_path from {one.format(by, '%s')} g
        join {one.format(by, '%s')} n using (dataset, {by}, print)"""


_CHANGES = f"""with l as (select dataset, path, types, required from ({_paths(_SPARSE)})),
    r as (select dataset, case when path = '.n_chars' then '.size.n_chars'
            else regexp_replace(path, '^\\.labels(\\.|$)', '.marks\\1') end as path, types, required from l
        union all select dataset, '.size', 'object', true from l where path = ''),
    diff as (select dataset, path, case when r.types is null then 'only_left' when l.types is null then 'only_right'
            when l.types <> r.types and l.required <> r.required then 'type_and_required_differ'
            when l.types <> r.types then 'type_differs' when l.required <> r.required then 'required_differs'
            else 'equal' end as outcome
        from l full join r using (dataset, path) where path <> '' and not ends_with(path, '[]')),
    gone as ({_alone('only_left', _prints('l'))}), new as ({_alone('only_right', _prints('r'))}),
    renamed as ({_met('parent') % ('gone', 'new')}),
    gone2 as (select * from gone g where not exists (select 1 from renamed m where m.dataset = g.dataset and m.path = g.path)),
    new2 as (select * from new n where not exists (select 1 from renamed m where m.dataset = n.dataset and m.to_path = n.path)),
    found as (select *, 'renamed' as how from renamed union all select *, 'moved' as how from ({_met('own') % ('gone2', 'new2')})),
    tops as (select g.dataset, g.path, f.to_path || substr(g.path, length(f.path) + 1) as to_path, f.how,
            row_number() over (partition by g.dataset, g.path order by length(f.path)) as nth
        from gone g join found f on f.dataset = g.dataset and (g.path = f.path or starts_with(g.path, f.path || '.'))),
    taken as (select t.dataset, t.path, t.to_path, t.how from tops t join new n on n.dataset = t.dataset and n.path = t.to_path where nth = 1)
    select dataset, path, to_path, how as outcome from taken union all
    select dataset, path, '', outcome from diff d where not exists (select 1 from taken t
        where t.dataset = d.dataset and (t.path = d.path or t.to_path = d.path))"""


def oracle_sql() -> dict[str, str]:
    profile = f"""select dataset, doc_id,
        count(*) filter (parent is not null and right(fullkey, 1) <> ']') as keys,
        max(1 + length(regexp_replace(fullkey, '[^.\\[]', '', 'g'))) as depth,
        count(*) filter (type = 'ARRAY') as arrays,
        count(*) filter (right(fullkey, 1) = ']') as array_len,
        any_value(length(json(j)::varchar))
            + count(*) filter (parent is not null and right(fullkey, 1) <> ']')
            + count(*) filter (parent is not null)
            - count(*) filter (type in ('OBJECT', 'ARRAY') and value::varchar not in ('{{}}', '[]'))
            as size_bytes
        from (select dataset, doc_id, json::json as j from (%s)), json_tree(j) group by all"""
    return {
        "scan_json_lines": """select 'collection=' || event_type as dataset, props as json from events
            where not (event_type in (select event_type from events
                where event_type = 'error' and event_id % 997 = 0 and event_id % 50 <> 0))""",
        "scan_json_array": f"""select 'collection=' || event_type || '-' || ({_INT_DIV}) as dataset,
            row_number() over (partition by event_type, {_INT_DIV} order by event_id) as doc_no,
            {corpora.ARRAY_ELEMENT_SQL} as json from events
            where not (event_type = 'error' and ({_INT_DIV}) % 2 = 1)
              and not (event_type = 'view' and ({_INT_DIV}) % 4 in (1, 2, 3))""",
        "detect_file_format": f"select dataset, format from ({_FORMATS})",
        "scan_manifest": f"""select file, object_type, coalesce(complexity, '') as complexity, keys, depth,
            arrays, array_len, size_bytes, coalesce(schema_generated, '') as schema_generated
            from ({_MANIFEST})""",
        "scan_schema_corpus": f"""select 'nation=' || s_nationkey as dataset,
            'supplier=' || s_suppkey as folder, {corpora.SUPPLIER_SCHEMA_SQL} as text from supplier""",
        "scan_documents": f"""select dataset, json from (select 'supplier=' || s_suppkey as dataset,
            {corpora.SUPPLIER_DOC_SQL} as json from supplier) where json_valid(json)""",
        "write_documents": """select event_type as dataset, 'document_' || event_id as doc_id,
            props as json from events""",
        "write_schemas": f"""select event_type as dataset, case when bool_and(
                json_type(props::json, '$.k') in ('UBIGINT', 'BIGINT') and len(json_keys(props::json)) = 1)
            then '{_K_SCHEMA}' end as schema_json from events group by 1""",
        "write_manifest": f"""select file, case when updated then 'true' else coalesce(old, '') end
            as schema_generated from ({_REFRESHED_FILE})""",
        "append_run_log": """select 'processed/' || role || '/c/' || conv_id || '_' || turn as original_file,
            'm' as model, case when turn % 2 = 0 then 'success' else 'failed' end as status,
            substr(replace(text, chr(10), ' '), 1, 2000) as message from conversations""",
        "sampling_plan": f"""select dataset, size_bytes, size_bytes <= {SAMPLE_BYTES} as keep_all,
            case when size_bytes <= {SAMPLE_BYTES} then 1
                 else greatest(1, round_even(size_bytes / {SAMPLE_BYTES}.0, 0)::bigint) end::bigint as k
            from (select {corpora.UNEVEN_SQL} as dataset, sum(strlen(props) + 1)::bigint as size_bytes
                  from events group by 1)""",
        "systematic_sample": f"""select dataset, doc_id, idx, json from (
            select *, row_number() over (partition by dataset order by doc_id) - 1 as idx
            from (select {corpora.UNEVEN_SQL} as dataset, event_id as doc_id, props as json from events))
            join (select {corpora.UNEVEN_SQL} as dataset,
                case when sum(strlen(props) + 1) <= {SAMPLE_BYTES} then 1 else greatest(1,
                    round_even(sum(strlen(props) + 1) / {SAMPLE_BYTES}.0, 0)::bigint) end as k
                from events group by 1) using (dataset) where idx % k = 0""",
        "split_documents": """select event_type as dataset, event_id as source_id, i as doc_no,
            'document_' || i as doc_id,
            case i when 1 then json(props)::varchar when 2 then event_id::varchar else '"x"' end as json
            from events, (select unnest([1, 2, 3])::bigint as i) where event_id % 9 <> 0""",
        "drop_empty_files": f"""select format, count(*) as files from ({_FORMATS})
            where format in ('empty', 'unknown') group by 1""",
        "assemble_documents": _ORDERS,
        "size_subsets": f"""select dataset, doc_id, floor((sum(strlen(json)) over (partition by dataset
            order by doc_id) - 1) / {SUBSET_BYTES}.0)::bigint as subset from ({_EVENTS_PROPS})""",
        "shred_documents": _nodes(_MIXED),
        "document_complexity": profile % _ORDERS,
        "classify_complexity": f"""select dataset, case when depth > 3 or keys > 100 or size_bytes > 30000
            then 'high' else 'low' end as complexity, count(*) as documents
            from ({profile % _MIXED}) group by all""",
        "build_manifest": f"""select file, object_type, case when depth > 3 or keys > 100
                or size_bytes > 30000 then 'high' else 'low' end as complexity,
            keys, depth, arrays, array_len, size_bytes, 'False' as schema_generated
            from ({profile % f"select case when event_id % 101 = 0 then '' else 'documents' end as dataset, {corpora.FILE_SQL} as doc_id, props as json from events"})
            t(object_type, file, keys, depth, arrays, array_len, size_bytes)""",
        "pending_documents": f"""select file, coalesce(schema_generated, '-') as flag from ({_MANIFEST})
            where lower(trim(coalesce(schema_generated, ''))) not in ('yes', 'true', '1')""",
        "approved_documents": f"""select {_DATASET} as dataset, file from ({_MANIFEST})
            where lower(trim(schema_generated)) = 'true' and {_DATASET} is not null""",
        "refresh_manifest": f"""select file, case when updated then 'true' else coalesce(old, '-') end
            as flag, updated from ({_REFRESHED})""",
        "refresh_report": f"""select count(*) as processed, count(*) filter (updated) as updated
            from ({_REFRESHED})""",
        "schema_pairs": """select 'rawJson/order_' || o_orderkey || '.json' as json_path,
            'processedSchemas/order_' || o_orderkey || '.schema.json' as schema_path from orders
            where o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT'""",
        "unprocessed_files": """select 'rawJson/order_' || o_orderkey || '.json' as file from orders
            where o_orderstatus <> 'P' and o_orderpriority = '1-URGENT'""",
        "route_by_complexity": f"""select file, case when lower(complexity) = 'low' then 'skip'
            else 'high' end as tier from ({_MANIFEST})
            where lower(trim(coalesce(schema_generated, ''))) not in ('yes', 'true', '1')""",
        "infer_schema": _paths(
            f"""select {_DATASET} as dataset, file as doc_id, props as json
            from ({_MANIFEST}) join (select {corpora.FILE_SQL} as file, props from events) using (file)
            where lower(trim(schema_generated)) = 'true' and {_DATASET} is not null"""
        ),
        "infer_path_types": f"select dataset, path, nodes, types from ({_paths(_ORDERS)})",
        "infer_required": f"""select dataset, path, required from ({_paths(_SPARSE)})
            where path <> '' and not ends_with(path, '[]')""",
        "infer_array_items": f"""select dataset, left(path, length(path) - 2) as array_path,
            nodes as items, types as item_types
            from ({_paths(f"{_MIXED} union all {_VECTORS}")}) where ends_with(path, '[]')""",
        "infer_file_schemas": _paths(
            f"""select f.dataset, coalesce(e.event_id, 0) as doc_id, case when e.e is null
                then '[' || f.elements || ']' else e.e end as json
            from (select * from ({_FORMATS}) where format in ('array', 'lines') and not broken) f
            left join ({_ELEMENTS}) e on f.format = 'lines' and e.event_type = f.event_type
                and e.chunk = f.chunk"""
        ),
        "infer_document_schemas": _paths(_MIXED, "dataset, doc_id"),
        "fuse_inferred_schemas": f"select dataset, path, types, required from ({_paths(_MIXED)})",
        "infer_incremental": _paths(_EVENTS_PROPS),
        "render_schema": _rendered(
            f"with p as ({_paths(_NULLABLE)})", '{"$schema": "' + SCHEMA_URI + '", '
        ),
        "render_pieces": _rendered(
            f"with p as ({_paths(_NULLABLE)})", '{"$schema": "' + SCHEMA_URI + '", '
        ),
        "propose_schemas": f"""select {corpora.FILE_SQL} as file, case when json_type(props::json, '$.k')
                in ('UBIGINT', 'BIGINT') and len(json_keys(props::json)) = 1 then '{_K_SCHEMA}' end as response
            from events""",
        "extract_json_block": f"""select dataset, file, {_BLOCK} <> '' and json_valid({_BLOCK}) as valid,
            case when {_BLOCK} <> '' and json_valid({_BLOCK}) then {_BLOCK} else trim(text) end
            as schema_text from ({_PROPOSALS})""",
        "proposal_outcomes": f"""select file as original_file,
            case when {_DATASET} is null then 'N/A' else 'large' end as model,
            case when {_DATASET} is null or event_id % 6 = 0 then 'failed' else 'success' end as status,
            case when {_DATASET} is null then '{BAD_PATH}'
                 when event_id % 6 = 0 then 'Timeout: ' || event_id
                 else 'Schema saved to processed/schema_documents/' || event_type
                    || '/documents/document_' || event_id || '.json' end as message
            from (select *, {corpora.FILE_SQL} as file, {corpora.FLAG_SQL} as flag,
                {corpora.COMPLEXITY_SQL} as complexity from events)
            where lower(trim(coalesce(flag, ''))) not in ('yes', 'true', '1')
                and ({_DATASET} is null or lower(coalesce(complexity, 'high')) <> 'low')""",
        "repair_schema_text": f"select dataset, file, status from ({_PARSED})",
        "repair_required": f"""{_WALK} select dataset, required_form, count(*) as nodes,
            count(*) filter (required_form <> 'array') as emptied from facts
            where required_form <> 'absent' group by all""",
        "repair_misplaced_properties": f"""{_WALK} select dataset, file, path, type_form,
            {_joined('types')} from facts where forced""",
        "repair_report": f"""{_WALK},
            per_file as (select p.dataset, p.file, p.status, coalesce(bool_or(f.bad), false) as rejected,
                count(*) filter (f.required_form not in ('absent', 'array')) as emptied,
                count(*) filter (f.forced) as forced
                from ({_PARSED}) p left join facts f using (dataset, file) group by all)
            select dataset, count(*) as files, count(*) filter (status = 'ok') as ok,
                count(*) filter (status = 'sliced') as sliced,
                count(*) filter (status = 'failed') as failed,
                count(*) filter (rejected) as rejected,
                count(*) filter (not rejected and status <> 'failed') as accepted,
                sum(emptied)::bigint as required_emptied, sum(forced)::bigint as objects_forced,
                count(*) filter (not rejected and status <> 'failed') > 0 as has_schema
            from per_file group by 1""",
        "schema_nodes": f"""{_VOTES} select dataset, file, path, {_joined('types')}, type_form,
            is_required from votes""",
        "path_stats": f"{_VOTES} select dataset, path, appearances, required_count from stats",
        "type_votes": f"{_VOTES} select dataset, path, type, votes from type_votes",
        "resolve_types": f"{_VOTES} select dataset, path, {_joined('types')} from resolved",
        "resolve_nullable": f"""{_VOTES} select dataset, path,
            array_to_string(final_types, '|') as types, nullable from with_null""",
        "resolve_required": f"{_VOTES} select dataset, path, required from resolved",
        "merge_schemas": f"{_VOTES} select dataset, path, {_joined('types')}, required from merged",
        "render_master_schema": _rendered(
            f"{_VOTES}, p as (select dataset, path, {_joined('types')}, required from merged)", "{"
        ),
        "schema_diff": f"""{_OFFLINE} select dataset, path, left_types, right_types, left_required,
            right_required, outcome from diff""",
        "schema_similarity": f"""{_OFFLINE}, sums as (select dataset, count(*) as paths,
            count(*) filter (outcome not in ('only_left', 'only_right')) as shared_paths,
            count(*) filter (outcome in ('equal', 'required_differs')) as same_type,
            count(*) filter (outcome in ('equal', 'type_differs')) as same_required
            from diff group by 1)
            select *, shared_paths / paths::double as path_overlap,
                case when shared_paths > 0 then same_type / shared_paths::double end as type_agreement,
                case when shared_paths > 0 then same_required / shared_paths::double end
                    as required_agreement from sums""",
        "schema_changes": _CHANGES,
    }
