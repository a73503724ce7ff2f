"""The catalogue's queries as plain SQL, for checking results in another engine.

Each statement starts from the raw tables. Shared steps are named blocks; a statement gets the blocks it
mentions, in the order they are defined here.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

BLOCKS: dict[str, str] = {}
ORACLE: dict[str, str] = {}

SEMVER = (
    "^v?(0|[1-9][0-9]*)([.](0|[1-9][0-9]*)([.](0|[1-9][0-9]*)"
    "(-[0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?([+][0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?)?)?$"
)
STRICT_SEMVER = SEMVER.replace("^v?", "^v")
LOOSE = (
    "^v?([0-9]+(?:[.][0-9]+)*)(?:-([0-9A-Za-z~-]+(?:[.][0-9A-Za-z~-]+)*))?"
    "(?:[+]([0-9A-Za-z~-]+(?:[.][0-9A-Za-z~-]+)*))?$"
)
WHITE_LIST = ("cmd", "build", "deployment", "script", "test", "init", "configs", "mock", "internal")


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def oracle(name: str, sql: str) -> None:
    """Register ``sql`` with every block it needs in front of it."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for other in BLOCKS:
            if other not in wanted and re.search(rf"\b{other}\b", text):
                wanted.add(other)
                need(BLOCKS[other])

    need(sql)
    head = ",\n".join(f"{n} as materialized (\n{BLOCKS[n]}\n)" for n in BLOCKS if n in wanted)
    ORACLE[name] = f"with {head}\n{sql}" if head else sql


def white_listed(path: str) -> str:
    return "(" + " or ".join(f"contains({path}, '/{e}') or starts_with({path}, '{e}/')" for e in WHITE_LIST) + ")"


def server(url: str) -> str:
    tail = f"case when strpos({url}, ':') > 0 then substr({url}, strpos({url}, ':') + 1) else '' end"
    return f"replace(regexp_replace({tail}, '[.]git$', ''), '/', '_')"


def sort_key(tag: str) -> str:
    number = "coalesce(nullif(ltrim(x, '0'), ''), '0')"
    return (
        f"list_transform(regexp_extract_all({tag}, '([0-9]+|[^0-9]+)'), lambda x: "
        f"case when regexp_matches(x, '^[0-9]') then concat(lpad(cast(length({number}) as varchar), 10, '0'), {number}) else x end)"
    )


def segments(tag: str) -> str:
    """First three numbers of a parsed tag."""
    body = f"regexp_extract({tag}, '{LOOSE}', 1)"
    return ", ".join(f"coalesce(try_cast(nullif(split_part({body}, '.', {i}), '') as bigint), 0) as {{p}}{i}" for i in (1, 2, 3))


# --- stand-in views ----------------------------------------------------------------------------------

block("v_release", """
with r as (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as n from orders)
select o_orderkey as rel_id, concat('github.com/c', o_custkey, '/repo') as module,
 concat('https://github.com/c', o_custkey, '/repo.git') as server_url,
 case when o_orderkey % 19 = 0 then concat('release-', n)
  else concat('v', cast(floor(n / 9) as int), '.', cast(floor(n / 3) as int) % 3, '.', n % 3,
   case when o_orderkey % 11 = 0 then '-rc1' when o_orderkey % 13 = 0 then '+incompatible' else '' end) end as tag,
 cast(cast(o_orderdate as date) as varchar) as tag_time, o_orderkey % 17 <> 0 as has_go_mod
from r""")
block("v_line", """
select r.rel_id, r.module, r.tag, l.l_partkey as p, l.l_suppkey as s, l.l_linenumber as ln, l.l_quantity as q, l.l_returnflag as rf,
 case l.l_suppkey % 4 when 0 then 'core' when 1 then 'client' when 2 then 'cmd' else 'main' end as pkg_name,
 concat(r.module, case l.l_suppkey % 4 when 0 then '/core' when 1 then '/client' when 2 then '/cmd/tool' else concat('/internal/x', l.l_partkey % 2) end) as pkg_path
from lineitem l join v_release r on r.rel_id = l.l_orderkey""")
block("v_package", """
select rel_id, module, tag, pkg_name, pkg_path, max(case when ln = 7 and q < 3 then 1 else 0 end) as n_errors
from v_line group by rel_id, module, tag, pkg_name, pkg_path""")
block("v_api_object", """
select rel_id, module, tag, pkg_path, obj_name, obj_name like 'S%' as exported,
 case (min(p) + min(ln)) % 4 when 0 then 'const' when 1 then 'var' when 2 then 'func' else 'type' end as obj_kind,
 case (min(p) + min(ln)) % 4 when 2 then 'function' else 'basic' end as type_kind,
 concat('T', min(ln) % 3) as type_str, cast(min(s) % 5 as varchar) as const_val,
 (min(p) + min(ln)) % 4 = 3 and max(s) % 3 = 0 as is_alias
from (select *, concat(case when q >= 45 then 'sym' else 'Sym' end, p % 8) as obj_name from v_line) x
group by rel_id, module, tag, pkg_path, obj_name""")


def _types(extra: str) -> str:
    keys = "rel_id" + (", pkg_path" if extra else "")
    return f"""
select *, case underlying_kind when 'basic' then basic_name
  when 'chan' then concat(case chan_dir when 'send' then 'chan<-' when 'recv' then '<-chan' else 'chan' end, ' ', basic_name)
  when 'interface' then 'interface{{...}}' else 'struct{{...}}' end as underlying_str
from (select {keys}, concat('Type', s % 3) as owner,
 case min(p) % 4 when 0 then 'basic' when 1 then 'chan' when 2 then 'interface' else 'struct' end as underlying_kind,
 case min(p) % 5 when 0 then 'uint8' when 1 then 'uint16' when 2 then 'int' when 3 then 'int64' else 'string' end as basic_name,
 case min(ln) % 3 when 0 then 'both' when 1 then 'send' else 'recv' end as chan_dir, min(q) > 10 as comparable
from v_line group by {keys}, concat('Type', s % 3)) t"""


def _fields(extra: str) -> str:
    keys = "rel_id" + (", pkg_path" if extra else "")
    return f"""
select *, field_name like 'F%' as exported from (
select {keys}, concat('Type', s % 3) as owner, concat(case when q >= 45 then 'f' else 'F' end, p % 5) as field_name,
 concat('T', min(ln) % 3) as type_str, max(case when ln % 4 = 0 then 1 else 0 end) = 1 as embedded, concat('Type', min(p) % 3) as embedded_owner
from v_line group by {keys}, concat('Type', s % 3), concat(case when q >= 45 then 'f' else 'F' end, p % 5)) f"""


def _methods(extra: str) -> str:
    keys = "rel_id" + (", pkg_path" if extra else "")
    types = "v_pkg_type" if extra else "v_api_type"
    return f"""
select m.*, t.underlying_kind as recv_kind, owner as recv_named, method_name like 'M%' as exported from (
select {keys}, concat('Type', s % 3) as owner, concat(case when q >= 45 then 'm' else 'M' end, p % 5) as method_name,
 min(ln) % 2 = 0 as ptr_receiver, concat('func(T', min(ln) % 3, ')') as sig_str
from v_line group by {keys}, concat('Type', s % 3), concat(case when q >= 45 then 'm' else 'M' end, p % 5)) m
join {types} t using ({keys}, owner)"""


block("v_api_type", _types(""))
block("v_api_field", _fields(""))
block("v_api_method", _methods(""))
block("v_pkg_type", _types("pkg"))
block("v_pkg_field", _fields("pkg"))
block("v_pkg_method", _methods("pkg"))
# Named types are objects of their package as well.
block("v_pkg_object", """
select rel_id, pkg_path, obj_name, exported, obj_kind, type_kind, type_str, const_val, is_alias from v_api_object
union all select rel_id, pkg_path, owner, true, 'type', concat('named|', underlying_kind), owner, '', false from v_pkg_type""")
block("v_dependency", """
select module as module_name, '1.19' as go_version, case when p % 29 = 0 then '' else tag end as tag, '' as tag_time,
 concat('github.com/c', p % 100, '/repo') as require_module_name, concat('v0.', s % 3, '.', ln % 3) as require_module_version, rf = 'R' as require_module_indirect
from v_line""")
block("v_identifier", """
select module as server_url, tag as version, case when ln % 2 = 0 then 'defs' else 'uses' end as var_type,
 concat('/tmp/', rel_id, '/src/a', ln, '.go:', ln, ':1') as id_pos, concat('Sym', s % 8) as obj_name,
 case when s % 9 = 0 then cast(null as varchar) else concat('package core ("github.com/c', p % 100, '/repo/core")') end as obj_pkg,
 case when s % 9 = 0 then 'var x int' else concat('func github.com/c', p % 100, '/repo/core.Sym', s % 8, '()') end as obj_string
from v_line""")
block("v_client", """
select distinct module_name as url, tag as version, concat(require_module_name, '/core') as path
from v_dependency where not require_module_indirect""")
block("v_imports", """
select module_name as server_url, tag as version, concat(require_module_name, '/core') as pkg_path, require_module_version as pkg_name
from v_dependency""")
block("v_root", """
select rel_id, pkg_path, concat('Sym', p % 8) as root, ln, p, s from v_line where q < 45""")
block("v_child", """
select rel_id, pkg_path, root, ln - 1 as slot, min(s) as s, min(p) as p from v_root group by rel_id, pkg_path, root, ln""")
block("v_type_node", """
with roots as (select rel_id, pkg_path, root, min(p) as p, max(s) as s from v_root group by rel_id, pkg_path, root)
select rel_id, pkg_path, root, '' as path, 'signature' as node_kind, '' as label, p % 7 = 0 as is_variadic from roots
union all select rel_id, pkg_path, root, '0', 'tuple', '', false from roots
union all select rel_id, pkg_path, root, '1', 'tuple', '', false from roots
union all select rel_id, pkg_path, root, '1/0', 'basic', 'error', false from roots where s % 2 = 0
union all select rel_id, pkg_path, root, concat('0/', slot), case when p % 3 = 0 then 'pointer' else 'basic' end, case when p % 3 = 0 then '' else concat('t', s % 2) end, false from v_child
union all select rel_id, pkg_path, root, concat('0/', slot, '/0'), 'named', concat('Type', s % 3), false from v_child where p % 3 = 0""")

# --- release pairs -----------------------------------------------------------------------------------

block("w_valid", f"""
select r.*, {sort_key('tag')} as k from v_release r
where has_go_mod and regexp_matches(tag, '{SEMVER}')""")
block("w_counted", """
select v.*, coalesce(n.n_packages, 0) as n_packages from w_valid v
left join (select rel_id, count(*) as n_packages from v_package group by rel_id) n using (rel_id)""")
block("w_pairs", """
select rel_id as pair_id, module, server_url, old_rel, rel_id as new_rel, old_tag, old_tag_time, tag as new_tag, tag_time as new_tag_time
from (select *, lag(rel_id) over w as old_rel, lag(tag) over w as old_tag, lag(tag_time) over w as old_tag_time, lag(n_packages) over w as old_n
 from w_counted window w as (partition by module order by k, tag)) x
where old_n > 0""")
block("w_sides", """
select pair_id, 'old' as side, old_rel as rel_id from w_pairs union all select pair_id, 'new', new_rel from w_pairs""")
block("w_package", "select rel_id, pkg_name, max(pkg_path) as pkg_path from v_package group by rel_id, pkg_name")


def aligned(sided: str, keys: Sequence[str], columns: Sequence[str], join: str = "full outer") -> str:
    """Both sides of a sided block next to each other."""
    on = ", ".join(keys)

    def side(name: str) -> str:
        return f"(select {on}, " + "".join(f"{c} as {name}_{c}, " for c in columns) + f"true as here_{name} from {sided} where side = '{name}') {name}_rows"

    columns_out = "".join(f"old_{c}, new_{c}, " for c in columns)
    return (
        f"select {on}, {columns_out}here_old is not null as in_old, here_new is not null as in_new\n"
        f"from {side('old')} {join} join {side('new')} using ({on})"
    )


ROW = "obj_key, node, object_kind, part, changed_type, message, compatible, cause"


def rows(scope: Sequence[str], source: str, rules: Sequence[tuple[str, ...]]) -> str:
    """Rule rows: (condition, obj_key, node, object_kind, part, changed_type, message, compatible, cause)."""
    names = ROW.split(", ")
    selects = [
        f"select {', '.join(scope)}, " + ", ".join(f"{value} as {name}" for value, name in zip(rule[1:], names)) + f" from {source} where {rule[0]}"
        for rule in rules
    ]
    return "\nunion all ".join(selects)


def object_rules(
    differs: str = "old_type_str <> new_type_str", cause: str = "case when old_type_kind = 'basic' then 'basic ' else '' end", moved: str = "false"
) -> list[tuple[str, ...]]:
    both = "in_old and in_new"
    typed = "(old_obj_kind = new_obj_kind and old_obj_kind in ('var', 'func') or old_obj_kind = 'func' and new_obj_kind = 'var')"
    const = "old_obj_kind = 'const' and new_obj_kind = 'const'"

    def rule(condition, kind, changed, text, side, cause):
        return (condition, "obj_name", "obj_name", kind, "''", changed, text, side, f"'{cause}'")

    return [
        rule("not in_new", "old_obj_kind", "old_type_kind", "'removed'", "false", "removed"),
        rule("not in_old", "new_obj_kind", "new_type_kind", "'added'", "true", "added"),
        rule(
            f"{both} and not {typed} and old_obj_kind <> new_obj_kind",
            "old_obj_kind", "'typeChanged'", "concat('changed from ', old_obj_kind, ' to ', new_obj_kind)", "false", "kind",
        ),
        rule(f"{both} and old_obj_kind = 'func' and new_obj_kind = 'var'", "old_obj_kind", "new_type_kind", "'changed from func to var'", "true", "kind"),
        rule(f"{both} and {typed} and {differs}", "old_obj_kind", "old_type_kind", f"concat({cause}, 'changed from ', old_type_str, ' to ', new_type_str)", "false", "kind"),
        rule(
            f"{both} and old_obj_kind = 'type' and new_obj_kind = 'type' and (old_is_alias or new_is_alias) and {differs}",
            "old_obj_kind", "old_type_kind", f"concat({cause}, 'changed from ', old_type_str, ' to ', new_type_str)", "false", "kind",
        ),
        rule(f"{both} and {const} and {differs}", "old_obj_kind", "old_type_kind", "concat('changed from ', old_type_str, ' to ', new_type_str)", "false", "kind"),
        rule(
            f"{both} and {const} and not {differs} and old_const_val <> new_const_val",
            "old_obj_kind", "old_type_kind", "concat('value changed from ', old_const_val, ' to ', new_const_val)", "false", "value",
        ),
        rule(
            f"{both} and old_obj_kind = 'type' and new_obj_kind = 'type' and not old_is_alias and not new_is_alias and {moved}",
            "old_obj_kind", "old_type_kind", "concat('changed from ', obj_name, ' to ', obj_name)", "false", "kind",
        ),
    ]


WIDENING = "(" + " or ".join(
    f"old_basic_name = '{line[i]}' and new_basic_name in ({', '.join(repr(n) for n in line[i + 1:])})"
    for line in (
        ("uint8", "uint16", "uint32", "uint", "uint64"),
        ("int8", "int16", "int32", "int", "int64"),
        ("float32", "float64"),
        ("complex64", "complex128"),
    )
    for i in range(len(line) - 1)
) + ")"
TYPE_COLUMNS = ("underlying_kind", "underlying_str", "basic_name", "chan_dir", "comparable")


def type_rules() -> list[tuple[str, ...]]:
    def rule(condition, changed, text, side, cause, part="''"):
        return (condition, "owner", "owner", "'type'", part, changed, text, side, f"'{cause}'")

    kind = "old_underlying_kind"
    same = "old_underlying_kind = new_underlying_kind"
    chan, basic, struct = (f"{same} and {kind} = '{k}'" for k in ("chan", "basic", "struct"))
    names = "concat('changed from ', old_basic_name, ' to ', new_basic_name)"
    return [
        rule(f"{kind} <> new_underlying_kind", kind, "concat('changed from ', old_underlying_str, ' to ', new_underlying_str)", "false", "kind"),
        rule(f"{chan} and old_basic_name <> new_basic_name", "'basic'", f"concat('basic ', {names})", "false", "kind", "', element'"),
        rule(f"{chan} and old_chan_dir <> new_chan_dir and new_chan_dir = 'both'", kind, "'removed direction'", "true", "direction"),
        rule(f"{chan} and old_chan_dir <> new_chan_dir and new_chan_dir <> 'both'", kind, "'changed direction'", "false", "direction"),
        rule(f"{basic} and old_basic_name <> new_basic_name and {WIDENING}", "new_underlying_kind", names, "true", "kind"),
        rule(f"{basic} and old_basic_name <> new_basic_name and not {WIDENING}", kind, names, "false", "kind"),
        rule(f"{struct} and old_comparable and not new_comparable", kind, "'old is comparable, new is not'", "false", "comparable"),
    ]


def field_rules(depths: bool) -> list[tuple[str, ...]]:
    def rule(condition, changed, text, side, cause):
        return (condition, "owner", "owner", "'type'", "field_name", changed, text, side, f"'{cause}'")

    out = [
        rule("not in_new", "'basic'", "'removed'", "false", "removed"),
        rule("not in_old", "'basic'", "'added'", "true", "added"),
        rule("in_old and in_new and old_type_str <> new_type_str", "'basic'", "concat('basic changed from ', old_type_str, ' to ', new_type_str)", "false", "kind"),
    ]
    if depths:
        out += [
            rule("in_old and in_new and old_depth = 0 and new_depth > 0", "'basic'", "'removed'", "false", "removed"),
            rule("in_old and in_new and old_depth > 0 and new_depth = 0", "'basic'", "'added'", "true", "added"),
        ]
    return out


METHOD_COLUMNS = ("ptr_receiver", "recv_kind", "recv_named", "sig_str")


def method_rules(value_set: bool, added: str = "true") -> list[tuple[str, ...]]:
    def node(side: str) -> str:
        return f"case when {side}_ptr_receiver then concat('(*', {side}_recv_named, ').', method_name) else concat({side}_recv_named, '.', method_name) end"

    def rule(condition, side, text, compatible, cause):
        part = f"concat(', ', {side}_recv_kind, ' method')"
        return (condition, f"concat('{side}:', {node(side)})", node(side), "'func'", part, "'function'", text, compatible, f"'{cause}'")

    both = "in_old and in_new"
    moved = "(not old_ptr_receiver and new_ptr_receiver)"
    text = "concat('changed from ', old_sig_str, ' to ', new_sig_str)"
    out = [
        rule("not in_new", "old", "'removed'", "false", "removed"),
        rule(f"{both} and old_sig_str <> new_sig_str and not {moved}", "old", text, "false", "kind"),
        rule(f"{both} and old_sig_str <> new_sig_str and {moved}", "new", text, "false", "kind"),
        rule("not in_old", "new", "'added'", added, "added"),
    ]
    if value_set:
        out += [
            rule(f"{both} and {moved}", "old", "'removed'", "false", "removed"),
            rule(f"{both} and old_ptr_receiver and not new_ptr_receiver", "new", "'added'", "true", "added"),
        ]
    return out


def promoted_rules() -> list[tuple[str, ...]]:
    """Rules of both method sets where a method may come from an embedded type (``owned`` is false)."""
    changed, added, *_ = method_rules(False)[1:3], method_rules(False)[3]
    key, node = method_rules(False)[0][1:3]
    by_set = "case when old_owned then concat(', ', old_recv_kind, ' method') else concat(', method set of {}', owner) end"
    removed = lambda condition, star: (condition, key, node, "'func'", by_set.format(star), "'function'", "'removed'", "false", "'removed'")
    return [
        removed("not in_new", "*"), *changed, added,
        removed("in_old and old_in_value and not coalesce(new_in_value, false) and (in_new or not old_owned)", ""),
        ("in_old and new_in_value and not old_in_value", *added[1:]),
    ]


def rule_blocks(prefix: str, scope: Sequence[str], types: str, fields: str, methods: str) -> None:
    """Blocks of all type rules over three sided blocks."""
    on = ", ".join(scope)
    owner = [*scope, "owner"]
    p = prefix
    block(f"{p}_types", aligned(types, owner, TYPE_COLUMNS, "inner"))
    block(f"{p}_type_rows", rows(scope, f"{p}_types", type_rules()))
    block(f"{p}_level0", f"select {on}, side, owner as root, owner, field_name, type_str, embedded, embedded_owner, exported from {fields}")
    previous = f"{p}_level0"
    entered = f"select {on}, side, root, owner from {p}_level0"
    for depth in (1, 2):
        block(
            f"{p}_level{depth}",
            f"select {', '.join('m.' + c for c in scope)}, m.side, i.root, m.owner, m.field_name, m.type_str, m.embedded, m.embedded_owner, m.exported\n"
            f"from (select * from {previous} c where embedded and not exists (select 1 from ({entered}) e where "
            + " and ".join(f"e.{c} = c.{c}" for c in (*scope, "side", "root"))
            + f" and e.owner = c.embedded_owner)) i\njoin {p}_level0 m on "
            + " and ".join(f"m.{c} = i.{c}" for c in (*scope, "side"))
            + " and m.root = i.embedded_owner",
        )
        block(
            f"{p}_clear{depth}",
            f"select {on}, side, root, min(owner) as owner, field_name, min(type_str) as type_str, bool_or(embedded) as embedded, "
            f"min(embedded_owner) as embedded_owner, bool_or(exported) as exported from {p}_level{depth} group by {on}, side, root, field_name having count(*) = 1",
        )
        previous = f"{p}_clear{depth}"
        entered += f" union all select {on}, side, root, owner from {p}_level{depth}"
    found = " union all ".join(
        f"select {on}, side, root, field_name, type_str, {depth} as depth from {source} where exported"
        for depth, source in enumerate((f"{p}_level0", f"{p}_clear1", f"{p}_clear2"))
    )
    block(
        f"{p}_selectable",
        f"select {on}, side, root as owner, field_name, min_by(type_str, depth) as type_str, min(depth) as depth from ({found}) f group by {on}, side, root, field_name",
    )
    struct = "old_underlying_kind = 'struct' and new_underlying_kind = 'struct'"
    block(f"{p}_struct_fields", f"select f.* from {p}_selectable f join (select {on}, owner from {p}_types where {struct}) t using ({on}, owner)")
    block(f"{p}_fields", aligned(f"{p}_struct_fields", [*owner, "field_name"], ("type_str", "depth")))
    block(f"{p}_field_rows", rows(scope, f"{p}_fields", field_rules(True)))

    plain = "old_underlying_kind = new_underlying_kind and old_underlying_kind <> 'interface'"
    block(f"{p}_plain_methods", f"select m.* from {methods} m join (select {on}, owner from {p}_types where {plain}) t using ({on}, owner) where exported")
    block(f"{p}_methods", aligned(f"{p}_plain_methods", [*owner, "method_name"], METHOD_COLUMNS))
    block(f"{p}_method_rows", rows(scope, f"{p}_methods", method_rules(True)))

    face = "old_underlying_kind = 'interface' and new_underlying_kind = 'interface'"
    block(f"{p}_face_methods", f"select m.* from {methods} m join (select {on}, owner from {p}_types where {face}) t using ({on}, owner)")
    block(
        f"{p}_sealed",
        f"select {on}, owner, coalesce(bool_or(side = 'old' and not exported), false) as sealed, "
        f"min(case when side = 'new' and not exported then method_name end) as hidden from {p}_face_methods group by {on}, owner",
    )
    block(f"{p}_open_methods", f"select m.*, sealed from {p}_face_methods m join {p}_sealed using ({on}, owner) where exported")
    block(f"{p}_faces", aligned(f"{p}_open_methods", [*owner, "method_name"], (*METHOD_COLUMNS, "sealed")))
    hidden = ("not sealed and hidden is not null", "owner", "owner", "'type'", "hidden", "'interface'", "'added unexported method'", "false", "'unexported'")
    block(
        f"{p}_face_rows",
        rows(scope, f"{p}_faces", method_rules(False, "new_sealed")) + "\nunion all " + rows(scope, f"{p}_sealed", [hidden]),
    )

    same = " and ".join(f"{{a}}.{c} = {{b}}.{c}" for c in scope)
    block(f"{p}_facts", f"select {on}, owner, new_underlying_kind as kind, {face} as is_face from {p}_types")
    block(
        f"{p}_held",
        f"select m.{', m.'.join(scope)}, m.side, m.owner, m.method_name, m.sig_str, is_face from {methods} m join {p}_facts using ({on}, owner) where is_face or not ptr_receiver",
    )

    # Methods an interface asks for and a type has, per side; as many as asked means implemented.
    block(
        f"{p}_matched",
        f"select f.{', f.'.join(scope)}, f.side, f.owner as face, t.owner, count(*) as n from {p}_held f join {p}_held t on {same.format(a='f', b='t')} "
        f"and f.side = t.side and f.method_name = t.method_name and f.sig_str = t.sig_str where f.is_face group by f.{', f.'.join(scope)}, f.side, f.owner, t.owner",
    )
    block(f"{p}_asked", f"select {on}, side, owner as face, count(*) as n from {p}_held where is_face group by {on}, side, owner")

    def tally(source: str, name: str, side: str, keys: str) -> str:
        return f"left join (select {on}, {keys}, n as {name} from {source} where side = '{side}') {name}_rows using ({on}, {keys})"

    block(
        f"{p}_broken",
        f"select {on}, owner, face, kind from (select {', '.join('t.' + c for c in scope)}, t.owner, f.owner as face, t.kind from {p}_facts f "
        f"join {p}_facts t on {same.format(a='f', b='t')} and f.owner <> t.owner where f.is_face) c\n"
        + "\n".join(
            [
                tally(f"{p}_asked", "asked_old", "old", "face"),
                tally(f"{p}_asked", "asked_new", "new", "face"),
                tally(f"{p}_matched", "had_old", "old", "face, owner"),
                tally(f"{p}_matched", "had_new", "new", "face, owner"),
            ]
        )
        + "\nwhere coalesce(had_old, 0) = coalesce(asked_old, 0) and coalesce(had_new, 0) < coalesce(asked_new, 0)",
    )
    rule = ("true", "owner", "owner", "'type'", "''", "concat('named|', kind)", "concat('no longer implements ', face)", "false", "'implements'")
    block(f"{p}_broken_rows", rows(scope, f"{p}_broken", [rule]))


def deduped(source: str, scope: Sequence[str]) -> str:
    rank = "case cause when 'removed' then 0 when 'kind' then 1 when 'comparable' then 2 when 'implements' then 3 else 4 end"
    return (
        f"select * from (select *, row_number() over (partition by {', '.join(scope)}, obj_key, part, compatible "
        f"order by {rank}, message, node, object_kind, changed_type) as place from {source}) d where place = 1"
    )


def reported(source: str, scope: Sequence[str]) -> str:
    node = "case when starts_with(part, ',') or part = '' then node when node = '' then part else concat(node, '.', part) end"
    text = "case when starts_with(part, ',') then concat(substr(part, 3), ' ', message) else message end"
    return (
        f"select {', '.join(scope)}, compatible, {node} as change_node, object_kind as changed_object, changed_type, "
        f"{text} as change_message from {source}"
    )


def union(*sources: str, scope: Sequence[str]) -> str:
    return " union all ".join(f"select {', '.join(scope)}, {ROW} from {s}" for s in sources)


OBJECT_SCOPE = ("pair_id", "pkg_path")
PAIR = ("pair_id",)
block("s_object", "select o.*, pair_id, side from v_api_object o join w_sides using (rel_id) where exported")
block("d_objects", aligned("s_object", [*OBJECT_SCOPE, "obj_name"], ("obj_kind", "type_kind", "type_str", "const_val", "is_alias")))
block("d_object_rows", rows(OBJECT_SCOPE, "d_objects", object_rules()))
block("d_object_best", deduped("d_object_rows", OBJECT_SCOPE))
block("d_changes", reported("d_object_best", OBJECT_SCOPE))
block("d_breaking", "select c.*, p.* exclude (pair_id) from d_changes c join w_pairs p using (pair_id) where not compatible and not contains(change_message, 'from unknown to unknown')")
block("s_type", "select t.*, pair_id, side from v_api_type t join w_sides using (rel_id)")
block("s_field", "select t.*, pair_id, side from v_api_field t join w_sides using (rel_id)")
block("s_method", "select t.*, pair_id, side from v_api_method t join w_sides using (rel_id)")
block("s_node", "select t.*, pair_id, side from v_type_node t join w_sides using (rel_id)")
block("s_package", "select t.*, pair_id, side from w_package t join w_sides using (rel_id)")
rule_blocks("d", PAIR, "s_type", "s_field", "s_method")

# --- which named type becomes which ------------------------------------------------------------------


def mapping_blocks(prefix: str, scope: Sequence[str], roots: str, children: str, named: str, members: str | None) -> str:
    """Blocks that map old named types to new ones; the name of the last one.

    ``roots`` are objects with a signature on both sides, ``children`` the parameters of either side, ``named`` the
    types of both sides (owner). ``members`` are the embedded fields that are entered round by round: with three
    names in a package the third round is the last that can change anything.
    """
    on, p = ", ".join(scope), prefix
    key = f"{on}, root, slot"
    block(f"{p}_params", aligned(children, [*scope, "root", "slot"], ("s", "p")))
    # Nothing is met in signatures of different counts, nor after the first parameter that differs in shape.
    block(
        f"{p}_shapes",
        f"select {key}, old_s, new_s, old_p, new_p, not coalesce(old_p % 3 = 0, false) and not coalesce(new_p % 3 = 0, false) and old_s % 2 <> new_s % 2 "
        f"or coalesce(old_p % 3 = 0, false) <> coalesce(new_p % 3 = 0, false) as bad, in_old and in_new as paired from {p}_params join (select {on}, root from {roots}) using ({on}, root)",
    )
    block(f"{p}_stops", f"select {on}, root, bool_and(paired) as even, min(case when bad then slot end) as stop from {p}_shapes group by {on}, root")
    block(
        f"{p}_direct",
        f"select {on}, concat('Type', old_s % 3) as old_name, concat('Type', new_s % 3) as new_name, "
        f"[root, '', '0000000000', lpad(cast(slot as varchar), 10, '0'), '0000000000'] as pos, cast([] as varchar[]) as chain "
        f"from {p}_shapes join {p}_stops using ({on}, root) where even and old_p % 3 = 0 and new_p % 3 = 0 and (stop is null or slot < stop)\n"
        f"union all select {on}, owner, owner, [owner], cast([] as varchar[]) from {named}",
    )

    def first(source: str) -> str:
        return f"select * exclude (place) from (select *, row_number() over (partition by {on}, old_name order by pos, new_name) as place from {source}) w where place = 1"

    last = f"{p}_round0"
    block(last, first(f"{p}_direct"))
    if members:
        block(f"{p}_members", f"select {on}, side, owner, field_name, embedded_owner from {members} where embedded")
        for step in range(1, 5):
            inside = (
                f"select {', '.join('m.' + c for c in scope)}, o.embedded_owner as old_name, n.embedded_owner as new_name, "
                f"list_append(m.pos, o.field_name) as pos, list_append(m.chain, m.old_name) as chain from {last} m "
                + " ".join(
                    f"join {p}_members {a} on {a}.side = '{side}' and {a}.owner = m.{side}_name and " + " and ".join(f"{a}.{c} = m.{c}" for c in scope)
                    for a, side in (("o", "old"), ("n", "new"))
                )
                + " and o.field_name = n.field_name where not list_contains(list_append(m.chain, m.old_name), o.embedded_owner)"
            )
            block(f"{p}_round{step}", first(f"(select * from {p}_direct union all {inside})"))
            last = f"{p}_round{step}"
    return last


block("s_child", "select c.*, pair_id, side from v_child c join w_sides using (rel_id)")
block("s_root", "select distinct pair_id, pkg_path, root, side from v_root join w_sides using (rel_id)")
block("d_roots", aligned("s_root", [*OBJECT_SCOPE, "root"], (), "inner"))
block("s_pkg_type", "select t.*, pair_id, side from v_pkg_type t join w_sides using (rel_id)")
block("s_pkg_field", "select t.*, pair_id, side from v_pkg_field t join w_sides using (rel_id)")
block("d_pkg_types", aligned("s_pkg_type", [*OBJECT_SCOPE, "owner"], ("underlying_kind",), "inner"))
T9_MAPPING = mapping_blocks("m", OBJECT_SCOPE, "d_roots", "s_child", "d_pkg_types", "s_pkg_field")

# --- the whole comparison, per package ---------------------------------------------------------------

FULL = ("pair_id", "pkg_name")
block("q_loaded", "select v.* from w_valid v where not exists (select 1 from v_package p where p.rel_id = v.rel_id and n_errors > 0)")
block("q_counted", f"""
select v.*, coalesce(n.n_packages, 0) as n_packages, coalesce(n.n_kept, 0) as n_kept from q_loaded v
left join (select rel_id, count(*) as n_packages, count_if(not {white_listed('pkg_path')}) as n_kept from w_package group by rel_id) n using (rel_id)""")


def kept_pairs(counted: str) -> str:
    """Neighbours where an emptied release is skipped as old side if it was compared itself."""
    return f"""
with placed as (select *, row_number() over w as n, lag(rel_id) over w as old_rel, lag(tag) over w as old_tag, lag(tag_time) over w as old_tag_time,
  n_packages > 0 and n_kept = 0 as emptied from {counted} window w as (partition by module order by k, tag)),
anchored as (select *, max(case when not emptied then n end) over (partition by module order by n rows between unbounded preceding and 1 preceding) as anchor from placed)
select a.rel_id as pair_id, a.module, a.server_url, a.old_rel, a.rel_id as new_rel, a.old_tag, a.old_tag_time, a.tag as new_tag, a.tag_time as new_tag_time
from anchored a left join placed b on b.module = a.module and b.n = a.anchor
where a.old_rel is not null and (case when (a.n - 1 - coalesce(a.anchor, 0)) % 2 = 0 then coalesce(b.n_packages > 0, false) else not coalesce(b.n_packages > 0, false) end)"""


block("q_pairs", kept_pairs("q_counted"))
block("q_sides", "select pair_id, 'old' as side, old_rel as rel_id from q_pairs union all select pair_id, 'new', new_rel from q_pairs")
block("q_s_package", f"select t.*, pair_id, side from w_package t join q_sides using (rel_id) where not {white_listed('pkg_path')}")
block("q_packages", aligned("q_s_package", FULL, ("rel_id", "pkg_path")))
block("q_package_sides", """
select pair_id, pkg_name, 'old' as side, old_rel_id as rel_id, old_pkg_path as pkg_path from q_packages where in_old and in_new
union all select pair_id, pkg_name, 'new', new_rel_id, new_pkg_path from q_packages where in_old and in_new""")
PACKAGE_RULES = [
    ("not in_new", "''", "''", "''", "''", "''", "concat(pkg_name, ': packages deleted')", "false", "'removed'"),
    ("not in_old", "''", "''", "''", "''", "''", "concat(pkg_name, ': packages new added')", "true", "'added'"),
]
block("q_package_rows", rows(FULL, "q_packages", PACKAGE_RULES))
for table, source in (("object", "v_pkg_object"), ("child", "v_child")):
    extra = " where exported" if table == "object" else ""
    block(f"q_s_{table}", f"select t.* , pair_id, pkg_name, side from {source} t join q_package_sides using (rel_id, pkg_path){extra}")
block("q_plain_objects", aligned("q_s_object", [*FULL, "obj_name"], ("obj_kind", "type_kind", "type_str", "const_val", "is_alias")))
# Every object has a signature; a type's is entered where its name is met first, at the same place.
block("q_met_roots", """
select pair_id, pkg_name, obj_name as root from q_plain_objects where in_old and in_new and starts_with(obj_name, 'Sym')
 and (old_obj_kind = new_obj_kind or old_obj_kind = 'func' and new_obj_kind = 'var')""")
block("q_shared_types", """
select pair_id, pkg_name, obj_name as owner from q_plain_objects
where in_old and in_new and old_obj_kind = 'type' and new_obj_kind = 'type' and not old_is_alias and not new_is_alias""")
block("q_mapping", f"select * from {mapping_blocks('qm', FULL, 'q_met_roots', 'q_s_child', 'q_shared_types', None)}")
# Rows of mapped types under the old name; a type that is met nowhere is not compared.
block("q_names", """
select pair_id, pkg_name, 'old' as side, old_name as owner, old_name from q_mapping union all select pair_id, pkg_name, 'new', new_name, old_name from q_mapping""")
for table, source in (("type", "v_pkg_type"), ("field", "v_pkg_field"), ("method", "v_pkg_method")):
    block(f"q_s_{table}", f"select t.* exclude (owner), old_name as owner, pair_id, pkg_name, side from {source} t join q_package_sides using (rel_id, pkg_path) join q_names using (pair_id, pkg_name, side, owner)")
block("q_s_node", "select t.*, pair_id, pkg_name, side from v_type_node t join q_package_sides using (rel_id, pkg_path)")
block("q_nodes", aligned("q_s_node", [*FULL, "root", "path"], ("node_kind", "label", "is_variadic")))
block("q_trees", """
select pair_id, pkg_name, root, bool_or(differs) as differs, concat_ws('|', case when bool_or(differs and starts_with(path, '0')) then 'params' end,
 case when bool_or(differs and starts_with(path, '1')) then 'returns' end, case when bool_or(differs and path = '') then 'variadic' end) as cause
from (select n.*, not coalesce(in_old and in_new and old_node_kind = new_node_kind and case old_node_kind
 when 'basic' then old_label = new_label when 'named' then coalesce(new_name, old_label) = new_label when 'signature' then old_is_variadic = new_is_variadic else true end, false) as differs
 from q_nodes n left join q_mapping m on m.pair_id = n.pair_id and m.pkg_name = n.pkg_name and m.old_name = n.old_label and n.old_node_kind = 'named') x
group by pair_id, pkg_name, root having bool_or(path = '' and in_old and in_new)""")
block("q_objects", """
select o.*, coalesce(t.differs, old_type_str <> new_type_str) as differs, coalesce(t.cause, case when old_type_kind = 'basic' then 'basic' else '' end) as cause,
 m.old_name is not null and m.new_name <> m.old_name as moved
from q_plain_objects o left join q_trees t on t.pair_id = o.pair_id and t.pkg_name = o.pkg_name and t.root = o.obj_name
left join q_mapping m on m.pair_id = o.pair_id and m.pkg_name = o.pkg_name and m.old_name = o.obj_name""")
block("q_object_rows", rows(FULL, "q_objects", object_rules("differs", "case when cause = '' then '' else concat(cause, ' ') end", "moved")))
rule_blocks("q", FULL, "q_s_type", "q_s_field", "q_s_method")
block(
    "q_all_rows",
    union("q_package_rows", "q_object_rows", "q_type_rows", "q_field_rows", "q_method_rows", "q_face_rows", "q_broken_rows", scope=FULL),
)
block("q_best", deduped("q_all_rows", FULL))
block("q_changes", reported("q_best", FULL))
block("q_breaking", """
select c.*, case when in_old then pkg_name else '' end as old_pkg_name, case when in_new then pkg_name else '' end as new_pkg_name,
 coalesce(old_pkg_path, '') as old_pkg_path, coalesce(new_pkg_path, '') as new_pkg_path, p.* exclude (pair_id)
from q_changes c join q_packages using (pair_id, pkg_name) join q_pairs p using (pair_id)
where not compatible and not contains(change_message, 'from unknown to unknown')""")


def minor_or_patch(source: str) -> str:
    """Rows of ``source`` whose update keeps the major number and moves forward."""
    parsed = ", ".join(segments(tag).format(p=p) for tag, p in (("old_tag", "o"), ("new_tag", "n")))
    plain = " and ".join(
        f"regexp_matches({t}, '^v?[0-9]+([.][0-9]+)*$') and len(string_split({t}, '.')) <= 3" for t in ("old_tag", "new_tag")
    )
    return f"select * exclude (o1, o2, o3, n1, n2, n3) from (select *, {parsed} from {source} where {plain}) m where o1 = n1 and (n2 > o2 or n2 = o2 and n3 > o3)"


DETAILS = """substr(server_url, 1, length(server_url) - 4) as url, array_to_string(list_slice(string_split(substr(server_url, 1, length(server_url) - 4), '/'), 4, 5), '/') as name,
 old_tag as version, old_tag_time as time, old_pkg_path as package_path, old_pkg_name as package_name,
 change_node, changed_object as change_object, changed_type as change_type, change_message"""
block("d_forward", minor_or_patch("(select *, pkg_path as old_pkg_path, 'p' as old_pkg_name from d_breaking) b"))
block("d_details", f"select {DETAILS} from d_forward")
block("q_forward", minor_or_patch("q_breaking"))

# --- statements --------------------------------------------------------------------------------------

CLONE_URL = "concat('https://', server_url, '.git')"
IDENTIFIER_REPORT = """
server_url, var_type, '' as id_name, regexp_extract(id_pos, '^[^/]*/[^/]*/[^/]*/(.*)$', 1) as id_pos, obj_name, '' as obj_pos,
 coalesce(obj_pkg, '') as obj_pkg, '' as obj_type, '' as obj_exported, '' as obj_id, obj_string, version"""
READ_BACK = "server_url, old_tag, old_tag_time as olg_tag_time, new_tag, pkg_path as old_pkg_path, 'p' as old_pkg_name, change_node, changed_object as \"changedObject\", changed_type as \"changedType\", change_message as \"changeMessage\""

oracle("read_repo_tasks", "select c_custkey as index, concat('c', c_custkey, '/repo') as full_name, concat('https://github.com/c', c_custkey, '/repo.git') as url, cast(c_nationkey as bigint) as star, true as count_matches from customer")
oracle("read_client_tasks", "select url, version, '' as path, string_agg(concat(path, '@@@core'), ';' order by path) as pkg_info from v_client group by url, version")
oracle("read_white_list", "select distinct pkg_name as entry from v_package")
oracle("read_dependencies", "select module_name, go_version, tag, tag_time, require_module_name, require_module_version, require_module_indirect from v_dependency")
oracle("read_change_report", f"select {READ_BACK} from d_breaking")
oracle("write_change_report", f"select {server('server_url')} as server_name, {READ_BACK}, new_tag_time, 'p' as new_pkg_name, pkg_path as new_pkg_path from d_breaking")
oracle("read_identifier_usage", f"select {IDENTIFIER_REPORT.replace('server_url', CLONE_URL + ' as server_url', 1)} from v_identifier")
oracle("write_identifier_usage", f"select {server(CLONE_URL)} as server, {IDENTIFIER_REPORT.replace('server_url', CLONE_URL + ' as server_url', 1)} from v_identifier")
oracle("read_imports", f"select {CLONE_URL} as server_url, pkg_path, min(pkg_name) as pkg_name, version from v_imports group by server_url, version, pkg_path")
oracle("write_imports", f"select {server(CLONE_URL)} as server, {CLONE_URL} as server_url, pkg_path, min(pkg_name) as pkg_name, version from v_imports group by server_url, version, pkg_path")
oracle("read_api_snapshot", """select 'release' as table_name, rel_id, '' as pkg_path, tag as name, server_url as fact from v_release
union all select 'package', rel_id, pkg_path, pkg_name, cast(n_errors as varchar) from v_package
union all select 'api_object', rel_id, pkg_path, obj_name, concat_ws('.', obj_kind, type_str, const_val) from v_pkg_object
union all select 'api_type', rel_id, pkg_path, owner, concat_ws('.', underlying_kind, underlying_str) from v_pkg_type
union all select 'api_field', rel_id, pkg_path, concat_ws('.', owner, field_name), type_str from v_pkg_field
union all select 'api_method', rel_id, pkg_path, concat_ws('.', owner, method_name), concat_ws('.', recv_kind, sig_str) from v_pkg_method
union all select 'api_type_node', rel_id, pkg_path, concat_ws('.', root, path), concat_ws('.', node_kind, label) from v_type_node""")
GRAPH = """
select 'node' as kind, module_name as from_name, tag as from_version, '' as to_name, '' as to_version, '' as indirect from v_dependency where tag <> ''
union select 'node', require_module_name, require_module_version, '', '', '' from v_dependency where tag <> ''
union select 'edge', module_name, tag, require_module_name, require_module_version, cast(require_module_indirect as varchar) from v_dependency where tag <> ''"""
oracle("upsert_module_graph", GRAPH)
oracle("append_module_graph", GRAPH)
oracle("dependency_graph", GRAPH)

oracle("repo_url", "select c_custkey, concat('https://github.com/c', c_custkey, '/repo.git') as url from customer")
oracle("server_name", f"select rel_id, {server('server_url')} as server_name, {server('module')} as without_colon from v_release")
oracle("report_file", f"select rel_id, concat({server('server_url')}, '_.csv') as change_file, concat({server('server_url')}, '_@@@release_', tag, '.csv') as usage_file from v_release")
oracle("pkg_path", "select url, version, string_agg(path, ';' order by path) as pkg_paths from v_client group by url, version")
oracle("strip_position", "select id_pos, regexp_extract(id_pos, '^[^/]*/[^/]*/[^/]*/(.*)$', 1) as inside, cast(null as varchar) as short from v_identifier")
oracle("repo_name_and_url", """select rel_id, substr(server_url, 1, length(server_url) - 4) as url,
 array_to_string(list_slice(string_split(substr(server_url, 1, length(server_url) - 4), '/'), 4, 5), '/') as name,
 array_to_string(list_slice(string_split(substr(server_url, 1, length(server_url) - 8), '/'), 4, 5), '/') as compat_name from v_release""")
oracle("strip_v", "select rel_id, case when starts_with(tag, 'v') then substr(tag, 2) else tag end as stripped from v_release")
STRIPPED = "case when starts_with(tag, 'v') then substr(tag, 2) else tag end"
oracle("is_valid_semver", f"select rel_id, regexp_matches(tag, '{SEMVER}') as valid, regexp_matches({STRIPPED}, '{STRICT_SEMVER}') as valid_compat, regexp_matches(tag, '{STRICT_SEMVER}') as valid_doubled from v_release")
oracle("version_sort_key", f"select rel_id, array_to_string({sort_key('tag')}, '/') as sort_key from v_release")
oracle("parse_version", f"""select rel_id, case when ok then concat(a1, '.', a2, '.', a3) end as segments, case when ok then regexp_extract(tag, '{LOOSE}', 2) end as prerelease, case when ok then regexp_extract(tag, '{LOOSE}', 3) end as metadata
from (select rel_id, tag, regexp_matches(tag, '{LOOSE}') as ok, {segments('tag').format(p='a')} from v_release) v""")
_KIND = """case when {a}_pre then 'prerelease' when {n}1 = {o}1 and {n}2 = {o}2 and {n}3 = {o}3 then 'same'
 when ({n}1, {n}2, {n}3) < ({o}1, {o}2, {o}3) then 'downgrade' when {n}1 > {o}1 then 'major' when {n}2 > {o}2 then 'minor' else 'patch' end"""
oracle("is_minor_or_patch", f"""select pair_id, not x_pre and o1 = n1 and (n2 > o2 or n2 = o2 and n3 > o3) as forward,
 not x_pre and o1 = n1 and (o2 > n2 or o3 > n3) as reverse_compat,
 {_KIND.format(a='x', o='o', n='n')} as kind, {_KIND.format(a='x', o='n', n='o')} as reverse_kind
from (select pair_id, contains(old_tag, '-') or contains(old_tag, '+') or contains(new_tag, '-') or contains(new_tag, '+') as x_pre,
 {segments('old_tag').format(p='o')}, {segments('new_tag').format(p='n')} from w_pairs) p""")
oracle("is_exported", "select rel_id, pkg_path, obj_name, regexp_matches(obj_name, '^[A-Z]') as by_name from v_api_object")
oracle("object_kind", "select rel_id, pkg_path, obj_name, obj_kind as kind, '???' as unknown from v_api_object")
oracle("type_kind", "select rel_id, owner as type_name, concat('pointer|named|', underlying_kind) as kind from v_api_type")
oracle("change_message", "select pair_id, pkg_path, obj_name, concat(case when old_obj_kind = 'func' then 'params ' else '' end, 'changed from ', old_type_str, ' to ', new_type_str) as message from d_objects where in_old and in_new")
oracle("drop_param_names", """select rel_id, p, s, ln, concat('func(T', ln % 3, ', ', case when p % 2 = 0 then '...' else '[]' end, 'T', s % 3, ')',
 case p % 3 when 0 then '' when 1 then ' string' else ' (string, error)' end) as signature from v_line""")
oracle("object_node", "select rel_id, owner, method_name, case when ptr_receiver then concat('(*', owner, ').', method_name) else concat(owner, '.', method_name) end as node, method_name as bare from v_api_method")
oracle("dot_join", """select rel_id, owner, field_name, case when embedded and not exported then '' when embedded then field_name when not exported then owner
 else concat(owner, '.', field_name) end as joined from v_api_field""")
oracle("change_node_and_text", """select pair_id, pkg_path, obj_name, case when in_old then pkg_path else concat(pkg_path, '.', obj_name) end as node,
 case when in_old then 'struct method changed' else 'changed' end as text from d_objects""")
oracle("what_changed", """select pair_id, owner, array_to_string(list_filter([case when old_basic_name <> new_basic_name then 'basic' end,
 case when old_chan_dir <> new_chan_dir then 'direction' end, case when old_comparable <> new_comparable then 'comparable' end], lambda x: x is not null), '|') as changed from d_types""")
oracle("first_line", "select rel_id, tag_time as first, tag_time as day, true as no_date from v_release")
oracle("bool_text", "select rel_id, case when has_go_mod then 'true' else 'false' end as flag from v_release")
oracle("obj_pkg_path", """select server_url, version, id_pos, regexp_extract(obj_pkg, '[(]"(.*)"[)]', 1) as path from v_identifier""")

oracle("drop_white_listed", f"select rel_id, pkg_name, pkg_path from v_package where not {white_listed('pkg_path')}")
oracle("drop_white_listed_by_table", """select rel_id, pkg_name, pkg_path from v_package p where not exists (
 select 1 from (select distinct concat(split_part(module, '/', 2), '/repo/c') as entry from v_release where not has_go_mod) e
 where contains(p.pkg_path, concat('/', entry)) or starts_with(p.pkg_path, concat(entry, '/')))""")
oracle("drop_blank", "select module_name, tag, require_module_name from v_dependency where tag <> ''")
oracle("touches_third_party", """select server_url, version, id_pos, obj_string, bool_or(contains(obj_string, path)) as touched, bool_or(contains(obj_string, concat(' ', path, '.'))) as strict
from (select *, row_number() over () as n from v_identifier) i join v_client c on c.url = i.server_url and c.version = i.version
group by n, server_url, i.version, id_pos, obj_string""".replace("select server_url, version", "select server_url, i.version"))
oracle("drop_null_objects", "select server_url, version, id_pos, obj_string from v_identifier where obj_pkg is not null")
oracle("drop_unversioned", "select module_name, tag, require_module_name, require_module_version, require_module_indirect from v_dependency where tag <> ''")
oracle("reportable", "select pair_id, pkg_path, change_node, change_message from d_breaking")
oracle("complete_releases", "select rel_id, module, tag from v_release r where rel_id not in (select rel_id from v_package where n_errors > 0)")
oracle("enough_tags", f"select rel_id, module, tag from (select *, count(*) over (partition by module) as n from v_release where regexp_matches(tag, '{SEMVER}')) r where n >= 2")
oracle("is_go_module", "select rel_id, module, tag from v_release where has_go_mod")
oracle("has_packages", "select url, version, count(*) as n_packages from v_client where contains(path, 'c1') group by url, version")
oracle("non_empty_reports", f"select distinct {server('server_url')} as server_name from d_breaking")
oracle("compatible_messages", "select pair_id, pkg_path, change_node, change_message from d_changes where compatible")

block("d_packages", aligned("s_package", FULL, ("pkg_path",)))
block("d_package_rows", rows((*FULL, "old_pkg_path", "new_pkg_path"), "d_packages", PACKAGE_RULES))
oracle("diff_packages", "select pair_id, pkg_name, coalesce(old_pkg_path, '') as old_pkg_path, coalesce(new_pkg_path, '') as new_pkg_path, compatible, message as change_message from d_package_rows")
oracle("diff_objects", "select pair_id, pkg_path, obj_name, case when not in_new then 'removed' when not in_old then 'added' else 'both' end as status, old_obj_kind, new_obj_kind from d_objects")
block("d_direct_source", "select * from s_field where exported")
block("d_direct_fields", aligned("d_direct_source", ("pair_id", "owner", "field_name"), ("type_str",)))
block("d_direct_rows", rows(PAIR, "d_direct_fields", field_rules(False)))
oracle("diff_fields", reported("d_direct_rows", PAIR))
block("d_any_source", "select * from s_method where exported")
block("d_any_methods", aligned("d_any_source", ("pair_id", "owner", "method_name"), METHOD_COLUMNS))
block("d_any_rows", rows(PAIR, "d_any_methods", method_rules(True)))
ROW_COLUMNS = "distinct pair_id, obj_key, node, object_kind, part, changed_type, message, compatible"
oracle("diff_methods", f"select {ROW_COLUMNS} from d_any_rows")
block("v_edges", "select distinct module_name as from_name, tag as from_version, require_module_name as to_name, require_module_version as to_version, require_module_indirect as indirect from v_dependency where tag <> ''")
oracle("downstream_clients", """select to_name as name, to_version as version, from_name as client_name, from_version as client_version, u.url as client_url
from v_edges join (select distinct module, tag from v_release) t on t.module = to_name and t.tag = to_version
join (select module, min(server_url) as url from v_release group by module) u on u.module = from_name where not indirect""")
oracle("no_longer_implements", "select pair_id, owner, face, kind from d_broken")
oracle("basic_widening", f"select pair_id, owner, old_basic_name, new_basic_name, {WIDENING} as widening from d_types where old_underlying_kind = 'basic' and new_underlying_kind = 'basic'")
oracle("third_party_usage", """select server_url, version, id_pos, obj_string from v_identifier i where exists (
 select 1 from v_client c where c.url = i.server_url and c.version = i.version and contains(i.obj_string, c.path))""")
block("d_nodes", aligned("s_node", ("pair_id", "pkg_path", "root", "path"), ("node_kind", "label", "is_variadic")))
block("d_node_diffs", """select *, not coalesce(in_old and in_new and old_node_kind = new_node_kind
 and case when old_node_kind in ('basic', 'named') then old_label = new_label when old_node_kind = 'signature' then old_is_variadic = new_is_variadic else true end, false) as type_differs from d_nodes""")
oracle("align_positions", "select pair_id, pkg_path, root, path, in_old, in_new, type_differs from d_node_diffs")
block("s_face", "select m.*, pair_id, side from v_api_method m join w_sides using (rel_id) where recv_kind = 'interface'")
block("d_all_faces", aligned("s_face", ("pair_id", "owner", "method_name"), ("sig_str",)))
oracle("align_interface_methods", "select pair_id, owner, count_if(in_old) as n_old, count_if(in_new) as n_new, count_if(in_old and in_new) as n_shared, count_if(coalesce(old_sig_str = new_sig_str, false)) as n_equal from d_all_faces group by pair_id, owner")
block("s_embedding", "select pair_id, side, owner, field_name, embedded_owner as target from s_field where embedded")
block("d_embedding", aligned("s_embedding", ("pair_id", "owner", "field_name"), ("target",), "inner"))
oracle("find_correspondence", """select e.pair_id, old_target as old_name, 'named' as new_kind, new_target as new_name, e.owner, e.field_name, t.owner is not null and old_target = new_target as agrees
from d_embedding e left join d_types t on t.pair_id = e.pair_id and t.owner = e.old_target""")
oracle("find_correspondence_renamed", """select e.pair_id, old_target as old_name, 'named' as new_kind, new_target as new_name, e.owner, e.field_name,
 t.owner is not null and new_target = concat('Type', (cast(substr(old_target, 5) as int) + e.pair_id) % 3) as agrees
from d_embedding e left join d_types t on t.pair_id = e.pair_id and t.owner = e.old_target""")
oracle("require_both", """select pair_id, pkg_path, obj_name, case when in_new then 'both' else 'old' end as found from (select o.pair_id, o.pkg_path, o.obj_name, exists (select 1 from n where n.pair_id = o.pair_id and n.pkg_path = o.pkg_path and n.obj_name = o.obj_name) as in_new
 from o) x""".replace("from n where", "from (select pair_id, pkg_path, obj_name from v_api_object join w_sides using (rel_id) where side = 'new') n where").replace("from o) x", "from (select pair_id, pkg_path, obj_name from v_api_object join w_sides using (rel_id) where side = 'old') o) x"))

oracle("packages_by_name", "select * from w_package")
oracle("distinct_imports", "select server_url, version, pkg_path, min(pkg_name) as pkg_name from v_imports group by server_url, version, pkg_path")
oracle("module_nodes", "select module_name as name, tag as version from v_dependency where tag <> '' union select require_module_name, require_module_version from v_dependency where tag <> ''")
oracle("module_edges", "select * from v_edges")
oracle("changes_by_old_version", "select * from d_details")
block("d_numbered", "select *, row_number() over (partition by name, url, version order by time, package_path, package_name, change_node, change_object, change_type, change_message) as n from d_details")
oracle("record_chunks", """select name, url, version, cast(floor((n - 1) / 3) as bigint) as chunk, count(*) as n_details, min_by(change_node, n) as first_node, min_by(change_message, n) as first_message
from d_numbered group by name, url, version, floor((n - 1) / 3)""")
block("d_doubled", f"select pair_id, {ROW} from d_type_rows union all select pair_id, {ROW.replace('message', 'concat(message, chr(33)) as message').replace('cause', chr(39) + 'removed' + chr(39))} from d_type_rows")
block("d_doubled_best", deduped("d_doubled", PAIR))
oracle("dedupe_messages", "select pair_id, obj_key, part, compatible, message, changed_type from d_doubled_best")
oracle("unambiguous_fields", "select rel_id, field_name, min(type_str) as type_str, bool_or(embedded) as embedded from v_api_field group by rel_id, field_name having count(*) = 1")
block("s_each", "select *, rel_id as pair_id, 'old' as side from v_api_field")
block("s_each_type", "select *, rel_id as pair_id, 'old' as side from v_api_type")
block("s_each_method", "select *, rel_id as pair_id, 'old' as side from v_api_method")
rule_blocks("e", PAIR, "s_each_type", "s_each", "s_each_method")
oracle("exported_selectable_fields", "select pair_id as rel_id, owner, field_name, type_str, depth from e_selectable")
oracle("render_report", """select distinct pair_id, pkg_path, cast(compatible as int) as section, 0 as line_kind, '' as node, case when compatible then 'Compatible changes:' else 'Incompatible changes:' end as line from d_changes
union all select pair_id, pkg_path, cast(compatible as int), 1, change_node, concat('- ', change_message) from d_changes""")
oracle("is_comparable", "select rel_id, owner, bool_and(type_str <> 'T0') as comparable from v_api_field group by rel_id, owner")
oracle("has_unexported_method", "select rel_id, owner, min(method_name) as unexported_method from v_api_method where not exported group by rel_id, owner")
block("d_kinds", f"""select b.*, {_KIND.format(a='x', o='o', n='n')} as update_kind from (select *, contains(old_tag, '-') or contains(old_tag, '+') or contains(new_tag, '-') or contains(new_tag, '+') as x_pre,
 {segments('old_tag').format(p='o')}, {segments('new_tag').format(p='n')} from d_breaking) b""")
oracle("change_counts", "select module, update_kind, changed_object, changed_type, count(*) as n_changes from d_kinds group by module, update_kind, changed_object, changed_type")
oracle("change_totals", """select module, update_kind, changed_object, changed_type, cast(grouping(module, update_kind, changed_object, changed_type) as int) as level, count(*) as n_changes
from d_kinds group by grouping sets ((module, update_kind), (module), (update_kind, changed_object, changed_type), (update_kind), (changed_object, changed_type), ())""")

oracle("adjacent_releases", "select * from w_pairs")
block("k_counted", f"""select v.*, coalesce(n.n_packages, 0) as n_packages, coalesce(n.n_kept, 0) as n_kept from w_valid v
left join (select rel_id, count(*) as n_packages, count_if(not {white_listed('pkg_path')}) as n_kept from w_package group by rel_id) n using (rel_id)""")
block("k_pairs", kept_pairs("k_counted"))
oracle("adjacent_kept_releases", "select pair_id, old_rel, old_tag, new_tag from k_pairs")
oracle("previous_tag_label", f"""select pair_id, raw_tag as old_tag, new_tag from w_pairs join (
 select rel_id as pair_id, lag(tag) over (partition by module order by {sort_key('tag')}, tag) as raw_tag from v_release) l using (pair_id)""")
oracle("order_tags", f"select rel_id, module, tag, row_number() over (partition by module order by {sort_key('tag')}, tag) as position from v_release")
oracle("order_changes", "select pair_id, pkg_path, compatible, change_node, change_message from d_changes")
oracle("order_methods", "select rel_id, owner, method_name as method_id, row_number() over (partition by rel_id, owner order by method_name) as place from v_api_method")
oracle("all_changes", reported("d_object_rows", OBJECT_SCOPE))
oracle("all_identifiers", "select server_url, version, var_type, id_pos from v_identifier")
oracle("added_or_removed", "select pair_id, pkg_path, obj_name, in_old, in_new from d_objects where in_old <> in_new")

oracle("check_objects", reported("d_object_rows", OBJECT_SCOPE))
oracle("check_named_types", reported("d_type_rows", PAIR))
oracle("check_structs", reported("d_field_rows", PAIR))
oracle("check_interfaces", f"select {ROW_COLUMNS} from d_face_rows")
oracle("check_method_sets", f"select {ROW_COLUMNS} from d_method_rows")
block("s_promoted", """select m.* replace (case when method_name in ('M1', 'M3') then 'Inner' else recv_named end as recv_named), method_name not in ('M1', 'M3') as owned,
 not ptr_receiver or method_name = 'M3' as in_value from d_plain_methods m""")
block("d_promoted", aligned("s_promoted", ("pair_id", "owner", "method_name"), (*METHOD_COLUMNS, "owned", "in_value")))
block("d_promoted_rows", rows(PAIR, "d_promoted", promoted_rules()))
oracle("check_promoted_method_sets", f"select {ROW_COLUMNS} from d_promoted_rows")
oracle("compare_types", """select pair_id, pkg_path, root, not bool_or(type_differs) as corresponds, case when bool_or(type_differs)
 then array_to_string(list_filter([case when bool_or(type_differs and starts_with(path, '0')) then 'params' end, case when bool_or(type_differs and starts_with(path, '1')) then 'returns' end,
 case when bool_or(type_differs and path = '') then 'variadic' end], lambda x: x is not null), '|') end as type_cause
from d_node_diffs group by pair_id, pkg_path, root having bool_or(path = '' and in_old and in_new)""")
block("s_shape", """select pair_id, side, owner as root, field_name as part, type_str, embedded, embedded_owner, cast(substr(field_name, 2) as int) % 2 = 1 as odd,
 ['array', 'slice', 'map', 'pointer', 'chan', 'struct', 'interface', 'basic'][1 + (cast(substr(field_name, 2) as int) * 3 + cast(substr(owner, 5) as int) + cast(embedded and type_str = 'T2' as int)) % 8] as kind from s_field""")
block("d_shape", aligned("s_shape", ("pair_id", "root", "part"), ("type_str", "embedded", "embedded_owner", "odd", "kind"), "inner"))
block("d_shape_facts", """select pair_id, root, part, old_kind as kind, old_kind <> new_kind as other_kind, old_odd as odd, old_type_str <> new_type_str as text, old_embedded_owner <> new_embedded_owner as target,
 old_odd and old_embedded <> new_embedded as mark, (old_embedded_owner <> 'Type0') <> (new_embedded_owner <> 'Type0') as fields, old_embedded_owner <> 'Type0' and old_type_str <> new_type_str as third,
 (old_embedded_owner = 'Type2' and old_type_str = 'T1') <> (new_embedded_owner = 'Type2' and new_type_str = 'T1') as methods from d_shape""")
block("d_shape_causes", """select *, case when other_kind then case kind when 'basic' then 'basic' else '' end
 when kind = 'array' and (target or text) then concat_ws('|', case when target then 'element' end, case when text then 'length' end)
 when kind in ('slice', 'chan') and text then 'element' when kind = 'pointer' and text then 'base' when kind = 'basic' and text then 'basic'
 when kind = 'map' and (target or text) then concat_ws('|', case when text then 'key' end, case when target then 'element' end)
 when kind = 'struct' then case when fields then 'fieldNumber' when mark then 'fieldAnonymous' when odd and target then 'fieldTag' when odd and text then 'fieldType' when third then 'fieldNames' end
 when kind = 'interface' then case when methods then 'methodNumber' when odd and (text or mark) then concat_ws('|', case when text then 'params' end, case when mark then 'variadic' end) when target then 'methodID' when text then 'params' end
 end as type_cause from d_shape_facts""")
oracle("compare_types_of_all_kinds", "select pair_id, root, part, type_cause is null as corresponds, type_cause from d_shape_causes")
oracle("type_kinds", """select rel_id, pkg_path, root, 'function' as type_kind from v_type_node where path = ''
union all select rel_id, pkg_path, concat(root, '.', slot), case when p % 3 = 0 then 'pointer|named' else 'basic' end from v_child""")
block("s_named_field", "select pair_id, side, owner as root, field_name as part, case when embedded then lower(embedded_owner) else field_name end as field_name, embedded from s_field")
block("d_named_field", aligned("s_named_field", ("pair_id", "root", "part"), ("field_name", "embedded"), "inner"))
oracle("embedded_names_correspond", """select pair_id, root, part, old_field_name, new_field_name, old_field_name = new_field_name
 or old_embedded and new_embedded and not regexp_matches(old_field_name, '^[A-Z]') and not regexp_matches(new_field_name, '^[A-Z]') as corresponds from d_named_field""")
oracle("establish_correspondence", f"select pair_id, pkg_path, old_name, 'named' as new_kind, new_name, array_to_string(pos, '/') as pos from {T9_MAPPING}")
oracle("unsupported_objects", "select rel_id, pkg_path, root, count(*) as n_unsupported from v_type_node where label = 't1' group by rel_id, pkg_path, root")
oracle("failed_objects", """select pair_id, pkg_name, side, root, 'typeParam' as unsupported_kind, count(*) as n_nodes, any_value(module) as module, any_value(old_tag) as old_tag, any_value(new_tag) as new_tag
from (select pair_id, pkg_name, side, root from q_s_node where label = 't1') n join (select pair_id, module, old_tag, new_tag from q_pairs) p using (pair_id) group by pair_id, pkg_name, side, root""")

BREAKING_REPORT = f"""select {server('server_url')} as server_name, server_url, old_tag, old_tag_time as olg_tag_time, new_tag, new_tag_time, old_pkg_name, new_pkg_name,
 old_pkg_path, new_pkg_path, change_node, changed_object as "changedObject", changed_type as "changedType", change_message as "changeMessage" from q_breaking"""
oracle("breaking_changes", BREAKING_REPORT)
block("v_loaded_client", "select * from v_client c where not exists (select 1 from v_package p where p.module = c.url and p.tag = c.version and n_errors > 0) and exists (select 1 from v_release r where r.module = c.url and r.tag = c.version and r.has_go_mod)")
block("v_used", """select * from v_identifier i where exists (
 select 1 from v_client c where c.url = i.server_url and c.version = i.version and contains(i.obj_string, c.path))""")
oracle("client_usage", f"""select {IDENTIFIER_REPORT} from v_identifier i where exists (
 select 1 from v_loaded_client c where c.url = i.server_url and c.version = i.version and contains(i.obj_string, c.path))""")
oracle("breaking_change_usage", """select f.module as library, f.old_tag, f.new_tag, f.old_pkg_path as obj_pkg_path, u.obj_name, f.change_node, f.change_message, u.server_url as client, u.version as client_version, u.id_pos
from v_used u join v_edges e on e.from_name = u.server_url and e.from_version = u.version and not e.indirect
join q_forward f on f.module = e.to_name and f.old_tag = e.to_version and concat('package core ("', f.old_pkg_path, '")') = u.obj_pkg and (f.change_node = '' or string_split(f.change_node, '.')[-1] = u.obj_name)""")
oracle("minor_patch_breaks", f"select {DETAILS} from q_forward")
oracle("stream_release_diff", BREAKING_REPORT)
oracle("watch_clients", """select d.module_name as client, d.tag as client_version, f.module as library, f.old_tag, f.new_tag, f.n_changes
from v_dependency d join (select module, old_tag, new_tag, count(*) as n_changes from q_forward group by module, old_tag, new_tag) f
on f.module = d.require_module_name and f.old_tag = d.require_module_version where d.tag <> '' and not d.require_module_indirect""")
oracle("client_imports", """select server_url, version, pkg_path, min(pkg_name) as pkg_name from v_imports i where exists (
 select 1 from v_loaded_client c where c.url = i.server_url and c.version = i.version) group by server_url, version, pkg_path""")
