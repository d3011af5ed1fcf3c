"""Style configurations as JSON: a declared schema, compiled to checks, defaults and comparisons over variants.

The schema is data. `errors_of` compiles it to one expression that gives every error with its path, `filled` to one
that gives a configuration as typed structs with defaults at any depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sedge.operators.records import NO_CONTEXT
from sedge.workspace import Scratch, dealt


@dataclass(frozen=True)
class Rule:
    """What a value must be. required: it must be there; optional: it may be null; default: what stands for a missing one."""

    kind: str
    required: bool = False
    optional: bool = False
    default: object = None
    values: tuple = ()
    low: int | None = None
    high: int | None = None
    parts: dict[str, Rule] = field(default_factory=dict, hash=False)
    item: Rule | None = None

    def must(self) -> Rule:
        return replace(self, required=True)

    def may(self) -> Rule:
        return replace(self, optional=True)


def text(default: str | None = None) -> Rule:
    return Rule("text", default=default)


def number(default: float | None = None) -> Rule:
    return Rule("number", default=default)


def flag(default: bool) -> Rule:
    return Rule("flag", default=default)


def choice(*values: str) -> Rule:
    """One of the values; the first is the default."""
    return Rule("choice", default=values[0], values=values)


def whole(low: int | None = None, high: int | None = None) -> Rule:
    return Rule("whole", low=low, high=high)


def part(**parts: Rule) -> Rule:
    return Rule("part", parts=parts)


def several(item: Rule) -> Rule:
    return Rule("list", item=item)


# The fields of a style configuration, their ranges and defaults.
FONT = part(
    family=text().must(), east_asia_family=text().may(), size_pt=number().must(), bold=flag(False), italic=flag(False),
    underline=flag(False), strikethrough=flag(False), color_hex=text("#000000"),
)
PARAGRAPH = part(
    font=FONT.must(), line_spacing=number(1.5), line_spacing_pt=number().may(), line_spacing_rule=choice("multiple", "exact", "at_least"),
    space_before_pt=number(0.0), space_after_pt=number(0.0), alignment=choice("left", "center", "right", "justify"), first_line_indent_chars=number(0.0),
    left_indent_cm=number(0.0), right_indent_cm=number(0.0), keep_together=flag(False), keep_with_next=flag(False), widow_control=flag(True),
)
HEADING = part(**PARAGRAPH.parts, level=whole(1, 6).must(), numbering_format=text().may(), outline_level=whole().may())
TABLE = part(
    border_style=choice("single", "double", "none", "three-line"), border_width_pt=number(0.5), border_width_top_pt=number().may(), border_width_bottom_pt=number().may(),
    border_width_left_pt=number().may(), border_width_right_pt=number().may(), border_width_inside_h_pt=number().may(), border_width_inside_v_pt=number().may(),
    header_font=FONT.must(), body_font=FONT.must(), header_bold=flag(True), header_bg_color=text().may(), header_repeat=flag(False),
    cell_padding_top_pt=number(2.0), cell_padding_bottom_pt=number(2.0), cell_padding_left_pt=number(2.0), cell_padding_right_pt=number(2.0),
    table_alignment=choice("left", "center", "right"), cell_vertical_alignment=replace(choice("top", "center", "bottom"), default="center"), rag_note=text().may(),
)
PAGE = part(
    paper_size=choice("A4", "A3", "B5", "Letter"), margin_top_cm=number(3.7), margin_bottom_cm=number(3.5), margin_left_cm=number(2.8), margin_right_cm=number(2.6),
    header_distance_cm=number(1.5), footer_distance_cm=number(1.75), orientation=choice("portrait", "landscape"), gutter_cm=number(0.0), page_number_format=text().may(),
)
_MAYBE = PARAGRAPH.may()
STYLE = part(
    page_layout=replace(PAGE, default={}), heading_styles=replace(several(HEADING), default=[]), body_style=PARAGRAPH.must(), table_style=TABLE.may(), list_style=_MAYBE, footnote_style=_MAYBE,
    caption_style=_MAYBE, header_footer_style=_MAYBE, cover_style=_MAYBE, preface_style=_MAYBE, appendix_title_style=_MAYBE, appendix_clause_style=_MAYBE, table_caption_style=_MAYBE,
    rag_sources=replace(several(text()), default=[]),
)
#: What is said of a wrong value (fixed values).
MISSING = "Field required"
WRONG = {
    "text": "Input should be a valid string", "number": "Input should be a valid number", "flag": "Input should be a valid boolean", "whole": "Input should be a valid integer",
    "part": "Input should be a valid dictionary", "list": "Input should be a valid list",
}
UNREAD = {"number": ", unable to parse string as a number", "flag": ", unable to interpret input", "whole": ", unable to parse string as an integer"}
FRACTION = ", got a number with a fractional part"
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
#: The compared fields and what they are called in a difference, in order, and what is said where a side is missing or nothing differs.
COMPARED = [
    *(("正文字体", "body_style.font", k) for k in ("family", "east_asia_family", "size_pt", "bold")),
    *(("正文", "body_style", k) for k in ("line_spacing", "first_line_indent_chars", "alignment")),
    *(("页面", "page_layout", k) for k in ("margin_top_cm", "margin_bottom_cm", "margin_left_cm", "margin_right_cm")),
    *(("表格", "table_style", k) for k in ("border_style", "border_width_pt", "header_bold", "table_alignment")),
]
CREATED, DELETED, SAME = "新建样式配置", "删除样式配置", "无显著差异"
#: The few-shot texts, and how much of a configuration they show.
NO_HISTORY, NO_EXAMPLE, SHOWN = "暂无历史调整记录。", "暂无有效的历史调整记录。", 200
ARROW = " -> "


def allowed(values: Sequence[str]) -> str:
    """What is said of a value that is none of a few."""
    quoted = [f"'{v}'" for v in values]
    return "Input should be " + (", ".join(quoted[:-1]) + " or " + quoted[-1] if len(quoted) > 1 else quoted[0])


def _bound(x: Column, make: Callable[[Column], Column]) -> Column:
    """make(x) with x worked out once, however often it stands there: nested expressions stay as large as the schema."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def _kind(x: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, OBJECT, ARRAY or VOID; null where the value is missing."""
    return F.substring_index(F.substring_index(F.schema_of_variant(x), "<", 1), "(", 1)


def _as(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def _number(x: Column) -> Column:
    """A number as it is taken: texts are read, truth values count as 0 and 1."""
    return _bound(_kind(x), lambda kind: _number_of(x, kind))


def _number_of(x: Column, kind: Column) -> Column:
    one = F.when(kind == "STRING", F.trim(_as(x, "string")).try_cast("double")).when(kind == "BOOLEAN", _as(x, "boolean").cast("double"))
    return one.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), _as(x, "double"))


_LEAF = "array<struct<name:string,kind:string,required:boolean,optional:boolean,wrong:string,unread:string,accepts:array<string>,low:double,high:double>>"


def _specs(rules: dict[str, Rule]) -> Column:
    """Rules of plain values as data."""
    rows = []
    for name, r in rules.items():
        wrong = allowed(r.values) if r.kind == "choice" else WRONG[r.kind]
        accepts = F.array(*map(F.lit, r.values or (TRUE + FALSE if r.kind == "flag" else ("",))))
        rows.append(F.struct(F.lit(name), F.lit(r.kind), F.lit(r.required), F.lit(r.optional), F.lit(wrong), F.lit(wrong + UNREAD.get(r.kind, "")), accepts, F.lit(r.low).cast("double"), F.lit(r.high).cast("double")))
    return F.array(*rows).cast(_LEAF)


def _leaf(r: Column, x: Column) -> Column:
    """What is wrong with a value under a rule; null where nothing is. Its kind is worked out once, and only where it is there."""
    return F.when(x.isNull(), F.when(r["required"], MISSING)).otherwise(_bound(_kind(x), lambda kind: _leaf_of(r, x, kind)))


def _leaf_of(r: Column, x: Column, kind: Column) -> Column:
    said = _as(x, "string")
    nested = kind.isin("OBJECT", "ARRAY")
    flag_ok = F.when(kind == "BOOLEAN", True).when(kind == "STRING", F.array_contains(r["accepts"], F.lower(F.trim(said)))).otherwise(F.coalesce(_number_of(x, kind).isin(0.0, 1.0), F.lit(False)))

    def number(value: Column) -> Column:
        broken = (r["kind"] == "whole") & (value != F.floor(value))
        bad = F.when(value.isNull(), F.when(kind == "STRING", r["unread"]).otherwise(r["wrong"]))
        bad = bad.when(broken & (kind == "STRING"), r["unread"]).when(broken, F.concat(r["wrong"], F.lit(FRACTION)))
        bad = bad.when(value < r["low"], F.concat(F.lit("Input should be greater than or equal to "), r["low"].cast("long").cast("string")))
        return bad.when(value > r["high"], F.concat(F.lit("Input should be less than or equal to "), r["high"].cast("long").cast("string")))

    said_of = F.when(kind == "VOID", F.when(~r["optional"], r["wrong"]))
    said_of = said_of.when(r["kind"] == "text", F.when(kind != "STRING", r["wrong"]))
    said_of = said_of.when(r["kind"] == "choice", F.when(~((kind == "STRING") & F.array_contains(r["accepts"], said)), r["wrong"]))
    said_of = said_of.when(r["kind"] == "flag", F.when(~flag_ok, F.when(nested, r["wrong"]).otherwise(r["unread"])))
    return said_of.otherwise(_bound(_number_of(x, kind), number))


_NONE = "array<struct<path:string,message:string>>"


def _said(path: list[Column], message: Column | str) -> Column:
    words = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(F.concat_ws(ARROW, *path).alias("path"), words.alias("message")))


def _each(rule: Rule, path: list[Column], values: Column) -> Callable[[Column], Column]:
    return lambda name: errors_of(rule, F.element_at(values, name), [*path, name])


def _plain(rules: dict[str, Rule], values: Column, path: list[Column]) -> Column:
    """Errors of fields with plain values: one expression for all, over their rules."""
    found = F.transform(_specs(rules), lambda r: F.struct(F.concat_ws(ARROW, *path, r["name"]).alias("path"), _bound(F.element_at(values, r["name"]), lambda x: _leaf(r, x)).alias("message")))
    return F.filter(found, lambda e: e["message"].isNotNull())


def errors_of(rule: Rule, x: Column, path: list[Column] | None = None) -> Column:
    """All errors (path, message) of a variant, in order of the fields.

    Neighbouring fields with plain values are checked by one expression over their rules, neighbouring parts of one rule by one
    over their names, so the expression is as large as the schema has different parts, not as it has fields.
    """
    return _bound(x, lambda y: _errors(rule, y, path or []))


def _errors(rule: Rule, x: Column, path: list[Column]) -> Column:
    none = F.array().cast(_NONE)
    if rule.kind == "part":
        inside = _bound(_as(x, "map<string,variant>"), lambda values: _errors_inside(rule, values, path))
    elif rule.kind == "list":
        own = rule.item.must()
        one = lambda y, k: errors_of(own, y, [*path, k.cast("string")])
        inside = F.flatten(F.transform(_as(x, "array<variant>"), one))
    else:
        return _bound(_leaf(F.get(_specs({"": rule}), F.lit(0)), x), lambda message: F.when(message.isNotNull(), _said(path, message)).otherwise(none))
    shape = "OBJECT" if rule.kind == "part" else "ARRAY"
    null = none if rule.optional else _said(path, WRONG[rule.kind])
    there = lambda kind: F.when(kind == "VOID", null).when(kind == shape, inside).otherwise(_said(path, WRONG[rule.kind]))
    return F.when(x.isNull(), _said(path, MISSING) if rule.required else none).otherwise(_bound(_kind(x), there))


def _errors_inside(rule: Rule, values: Column, path: list[Column]) -> Column:
    found, names = [], list(rule.parts)
    while names:
        own = rule.parts[names[0]]
        alike = (lambda r: r.kind not in ("part", "list")) if own.kind not in ("part", "list") else (lambda r, own=own: r is own)
        n = next((k for k, name in enumerate(names) if not alike(rule.parts[name])), len(names))
        if own.kind in ("part", "list"):
            found.append(F.flatten(F.transform(F.array(*map(F.lit, names[:n])), _each(own, path, values))))
        else:
            found.append(_plain({name: rule.parts[name] for name in names[:n]}, values, path))
        names = names[n:]
    return F.concat(*found)


def validate_style(table: DataFrame, config: str, rule: Rule = STYLE) -> DataFrame:
    """The rows with `faults`, the errors (path, message) of the JSON text in `config`; a text that is no JSON is no dictionary."""
    # The variant is computed once: the expression refers to it many times.
    read = table.withColumn("_v", F.coalesce(F.try_parse_json(config), F.parse_json(F.lit("null"))))
    return read.withColumn("faults", errors_of(rule, F.col("_v"))).drop("_v")


def fault_texts(faults: Column) -> Column:
    """'[a -> b] message' of every error."""
    return F.transform(faults, lambda e: F.concat(F.lit("["), e["path"], F.lit("] "), e["message"]))


def fault_rollup(checked: DataFrame) -> DataFrame:
    """Rows and errors by path and message; places in lists count as one."""
    one = checked.select(F.explode("faults").alias("e"))
    place = F.regexp_replace("e.path", r"(?<= -> )\d+(?= -> |$)", "*")
    return one.groupBy(place.alias("path"), F.col("e.message").alias("message")).agg(F.count(F.lit(1)).alias("errors"))


def quarantine(checked: DataFrame, folder: str) -> DataFrame:
    """Rows with errors go to a table in the folder, with their errors; the others are returned."""
    checked.where(F.size("faults") > 0).withColumn("errors", fault_texts(F.col("faults"))).drop("faults").write.mode("overwrite").parquet(folder)
    return checked.where(F.size("faults") == 0).drop("faults")


#: Truth values are read as texts, since more words stand for them than a cast knows.
_TYPES = {"text": "string", "choice": "string", "number": "double", "flag": "string", "whole": "long"}


def ddl(rule: Rule) -> str:
    if rule.kind == "part":
        return f"struct<{','.join(f'{n}:{ddl(r)}' for n, r in rule.parts.items())}>"
    return f"array<{ddl(rule.item)}>" if rule.kind == "list" else _TYPES[rule.kind]


def filled(rule: Rule, x: Column) -> Column:
    """A struct of the schema with its missing fields set to their defaults, at any depth; given values stay."""
    if rule.kind == "part":
        made = F.struct(*(filled(r, x[n]).alias(n) for n, r in rule.parts.items()))
        return made if rule.default == {} else F.when(x.isNotNull(), made)
    if rule.kind == "list":
        given = F.transform(x, lambda y: filled(rule.item, y))
        return F.coalesce(given, F.array()) if rule.default == [] else given
    if rule.kind == "flag":
        x = F.when(F.lower(F.trim(x)).isin(*TRUE), True).when(F.lower(F.trim(x)).isin(*FALSE), False)
    return x if rule.default is None else F.coalesce(x, F.lit(rule.default))


def apply_style_defaults(table: DataFrame, config: str, rule: Rule = STYLE, into: str = "style") -> DataFrame:
    """The rows with the configuration as a struct. One that is no JSON object becomes null; values are not checked here."""
    read = table.withColumn("_v", F.try_variant_get(F.try_parse_json(config), "$", ddl(rule)))
    return read.withColumn(into, filled(replace(rule, default=None), F.col("_v"))).drop("_v")


def _shown(x: Column, kind: Column, written: Column) -> Column:
    """A value as it is shown in a difference: None, True, False, texts, and numbers as they are written."""
    return F.when(x.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(written)).otherwise(written)


def _differs(a: Column, b: Column, ka: Column, kb: Column) -> Column:
    """Null-safe; numbers and truth values are compared as numbers, whatever their form."""
    there = lambda k: F.coalesce(k != "VOID", F.lit(False))
    plain = lambda k: k.isin("STRING", "OBJECT", "ARRAY")
    same = F.when(plain(ka) | plain(kb), (ka == kb) & (F.to_json(a) == F.to_json(b))).otherwise(_number_of(a, ka) == _number_of(b, kb))
    return F.when(there(ka) & there(kb), ~same).otherwise(there(ka) | there(kb))


def style_diff(table: DataFrame, before: str, after: str) -> DataFrame:
    """The rows with `diff`: '组.field: old → new' of the compared fields that differ, joined by '; '.

    Null, '{}' and what is no JSON object count as a missing side.
    """
    read = table.withColumn("_a", F.try_parse_json(before)).withColumn("_b", F.try_parse_json(after))
    there = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT") & (F.schema_of_variant(c) != "OBJECT<>"), F.lit(False))
    fields = F.array(*(F.struct(F.lit(f"{group}.{name}: ").alias("name"), F.lit(f"$.{where}.{name}").alias("path")) for group, where, name in COMPARED))

    written = lambda c, p: F.call_function("get_json_object", F.col(c), p["path"])

    def tell(p: Column) -> Column:
        """One expression over the fields, in order. Texts are read again for how a value is written, only where it differs."""
        a, b = (F.try_variant_get(F.col(c), p["path"], "variant") for c in ("_a", "_b"))
        met = F.struct(a.alias("a"), b.alias("b"), _kind(a).alias("ka"), _kind(b).alias("kb"))
        sides = lambda m: F.concat(p["name"], _shown(m["a"], m["ka"], written(before, p)), F.lit(" → "), _shown(m["b"], m["kb"], written(after, p)))
        return _bound(met, lambda m: F.when(_differs(m["a"], m["b"], m["ka"], m["kb"]), sides(m)))

    changes = F.array_join(F.transform(fields, tell), "; ")
    both = F.when(there("_a") & there("_b"), F.when(changes == "", SAME).otherwise(changes))
    return read.withColumn("diff", both.when(there("_b"), CREATED).otherwise(DELETED)).drop("_a", "_b")


def flat_paths(table: DataFrame, key: str, config: str, depth: int = 3) -> DataFrame:
    """key, path, value (as JSON) of the leaves of JSON objects, down to a depth; what lies deeper is one value, as lists are."""
    rows = table.select(F.col(key).alias("_k"), F.lit("").alias("path"), F.try_parse_json(config).alias("v"))
    done = []
    for k in range(depth):
        level = rows.where(_kind(F.col("v")) == "OBJECT").select("_k", "path", F.explode(_as(F.col("v"), "map<string,variant>")).alias("name", "v"))
        rows = level.select("_k", F.concat_ws(".", F.nullif("path", F.lit("")), "name").alias("path"), "v")
        done.append(rows if k == depth - 1 else rows.where(_kind(F.col("v")) != "OBJECT"))
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.select(F.col("_k").alias(key), "path", F.to_json("v").alias("value"))


def merge_json(left: Column, right: Column) -> Column:
    """Two JSON objects as one, fields of the right one winning as a whole; what is no object counts as empty. Fields come by name."""
    fields = lambda c: F.coalesce(_as(F.try_parse_json(c), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    a, b = fields(left), fields(right)
    # Names are distinct when the maps meet, whatever the session says of double keys.
    return F.to_json(F.to_variant_object(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)))


def newest_of(history: DataFrame, n: int, key: str) -> DataFrame:
    """The newest n rows of every key with their places `_n`."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("created_at"), "id"))
    return history.withColumn("_n", place).where(F.col("_n") <= n)


def few_shot_texts(wanted: DataFrame, history: DataFrame, n: int = 3, key: str = "standard") -> DataFrame:
    """key and `examples` of every wanted key: its newest n adjustments (source, before, after, diff; created_at, id), the complete ones as one text.

    Which are complete is asked after the newest are taken. No adjustment, or no complete one, has a text of its own.
    """
    newest = newest_of(history, n, key)
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    # An empty object is no configuration.
    complete = given("diff") & given("before") & (F.col("before") != "{}") & given("after") & (F.col("after") != "{}")
    shown = lambda c: F.concat(F.left(c, F.lit(SHOWN)), F.lit("..."))
    one = F.concat(F.lit("- 调整来源: "), "source", F.lit("\n  差异: "), "diff", F.lit("\n  调整前: "), shown("before"), F.lit("\n  调整后: "), shown("after"))
    told = newest.withColumn("_x", F.when(complete, one)).groupBy(key).agg(F.expr("listagg(_x, '\n') within group (order by _n)").alias("_t"), F.count(F.lit(1)).alias("_c"))
    met = wanted.select(key).distinct().join(told.hint("merge"), key, "left")
    return met.select(key, F.when(F.col("_c").isNull(), NO_HISTORY).otherwise(F.coalesce("_t", F.lit(NO_EXAMPLE))).alias("examples"))


def style_prompt(template: Column, document_type: Column, standard: Column, special: Column, results: Column, examples: Column) -> Column:
    """The template with its five names in braces replaced one after another; what is missing or empty has a text of its own.

    special: texts of what is special in the document. results: found texts, best first, of which five are shown.
    """
    say = lambda c, other: F.when(F.length(c) > 0, c).otherwise(other)
    listed = lambda c, most, joint, other: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(c, 1, most), joint)).otherwise(other)
    values = {
        "document_type": say(document_type, "通用文档"), "detected_standard": say(standard, "GB/T 9704"), "special_elements": listed(special, 1 << 30, "、", "无特殊元素"),
        "rag_context": listed(results, 5, "\n\n", NO_CONTEXT), "few_shot_examples": F.coalesce(examples, F.lit(NO_HISTORY)),
    }
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


# Fixtures: configurations of the rows of `part`, most of them with one planted fault, by the key modulo 48. The text is
# SQL that both engines read, so that both get the same JSON.
_FONT = """(CASE p_partkey % 48 WHEN 1 THEN '{"family": "Arial"}' WHEN 2 THEN '{"family": 5, "size_pt": " 12 "}' WHEN 3 THEN '{"family": "Arial", "size_pt": "big", "bold": "maybe"}'
 WHEN 4 THEN '{"family": "Arial", "size_pt": true, "bold": 1, "italic": "Yes", "underline": 2, "color_hex": null}' WHEN 5 THEN '{"size_pt": [1], "family": null, "east_asia_family": 7}'
 ELSE concat('{"family": "Arial", "east_asia_family": null, "size_pt": ', CAST(p_size AS STRING), '.5}') END)"""
_PAGE = """(CASE p_partkey % 48 WHEN 6 THEN '{"margin_top_cm": null}' WHEN 7 THEN 'null' WHEN 8 THEN '{"paper_size": "A5", "gutter_cm": "x"}' WHEN 9 THEN '7'
 ELSE concat('{"paper_size": "A4", "margin_top_cm": ', CAST(p_size % 5 AS STRING), ', "margin_left_cm": 2.5}') END)"""
_HEADINGS = """(CASE p_partkey % 48 WHEN 10 THEN '{}' WHEN 11 THEN concat('[{"level": 9, "font": ', F, '}, {"level": "2", "font": ', F, '}, 7]') WHEN 12 THEN concat('[{"level": 2.5, "font": ', F, '}, {"font": null, "level": 0}, {"font": ', F, '}]')
 WHEN 13 THEN 'null' ELSE concat('[{"level": 1, "font": ', F, ', "alignment": "center"}]') END)"""
_TABLE = """(CASE p_partkey % 48 WHEN 14 THEN concat('{"border_style": "dotted", "header_font": ', F, '}') WHEN 15 THEN '"none"' WHEN 16 THEN 'null'
 ELSE concat('{"header_font": ', F, ', "body_font": ', F, ', "border_width_pt": 0.5, "header_bold": ', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}') END)"""
_BODY = """(CASE p_partkey % 48 WHEN 17 THEN '"x"' ELSE concat('{"font": ', F, ', "line_spacing": ', CASE WHEN p_size % 3 = 0 THEN '1.0' ELSE '1.5' END, ', "alignment": "', CASE WHEN p_size % 4 = 0 THEN 'justify' ELSE 'left' END, '"}') END)"""
_LIST = """(CASE p_partkey % 48 WHEN 18 THEN concat('{"font": ', F, ', "line_spacing_rule": "loose", "keep_together": "x", "left_indent_cm": {}}') WHEN 19 THEN '[]' ELSE 'null' END)"""
_SOURCES = """(CASE p_partkey % 48 WHEN 20 THEN '["a", 1, null]' WHEN 21 THEN '"x"' ELSE '["GB/T 1.1"]' END)"""
STYLE_JSON = (
    f"""(CASE p_partkey % 48 WHEN 22 THEN '[1]' WHEN 23 THEN 'no JSON' ELSE concat('{{"page_layout": ', {_PAGE}, ', "heading_styles": ', {_HEADINGS}, CASE WHEN p_partkey % 48 = 0 THEN '' ELSE concat(', "body_style": ', {_BODY}) END,
 ', "table_style": ', {_TABLE}, ', "list_style": ', {_LIST}, ', "rag_sources": ', {_SOURCES}, CASE WHEN p_size % 2 = 0 THEN ', "caption_style": null' ELSE ', "other": [1]' END, '}}') END)"""
).replace("F,", f"{_FONT},").replace("\n", " ")
#: The other side of a comparison: the configuration of the same row as if its key were another, or none.
OTHER_JSON = "(CASE WHEN p_size % 11 = 0 THEN '{}' WHEN p_size % 11 = 1 THEN NULL ELSE " + STYLE_JSON.replace("p_partkey", "(p_partkey + p_size)").replace("p_size % 5", "p_size % 4").replace("p_size % 3", "p_size % 5") + " END)"


def _configs(s: SparkSession, d: str) -> DataFrame:
    return _as_configs(dealt(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice", "p_brand")))


def _as_configs(parts: DataFrame) -> DataFrame:
    return parts.select("p_partkey", "p_size", "p_retailprice", "p_brand", F.expr(STYLE_JSON).alias("config"), F.expr(OTHER_JSON).alias("other"))


def _checked(s, d):
    return validate_style(_configs(s, d), "config")


def _quarantined(s, d):
    scratch = Scratch(s, "quarantine")
    folder = f"{scratch.root}/faulty"
    checked = scratch.keep(_checked(s, d), "checked")  # both parts read it
    good = scratch.keep(quarantine(checked, folder), "sound").select("p_partkey", F.lit("sound").alias("part"), F.lit(0).cast("long").alias("errors"))
    return good.unionByName(s.read.parquet(folder).select("p_partkey", F.lit("faulty").alias("part"), F.size("errors").cast("long").alias("errors")))


_READ_BACK = ["page_layout.margin_top_cm", "page_layout.gutter_cm", "page_layout.orientation", "body_style.font.size_pt", "body_style.font.bold", "body_style.line_spacing", "body_style.widow_control", "table_style.border_style", "table_style.header_font.color_hex", "table_style.cell_vertical_alignment", "list_style.keep_together"]


def _filled(s, d):
    style = apply_style_defaults(_checked(s, d).where(F.size("faults") == 0), "config")
    first = F.get("style.heading_styles", F.lit(0))
    return style.select(
        "p_partkey", *(F.col(f"style.{c}").alias(c.replace(".", "_")) for c in _READ_BACK), first["line_spacing"].alias("heading_line_spacing"), first["font"]["italic"].alias("heading_italic"), first["level"].alias("heading_level"),
        F.size("style.heading_styles").cast("long").alias("headings"), F.array_join("style.rag_sources", ",").alias("sources"),
    )


def _history(parts: DataFrame) -> DataFrame:
    told = style_diff(_as_configs(parts), "config", "other")
    source = F.when(F.col("p_size") % 2 == 0, "chat").otherwise("form")
    return told.select(F.col("p_brand").alias("standard"), source.alias("source"), F.col("config").alias("before"), F.col("other").alias("after"), F.when(F.col("p_size") % 7 > 0, F.col("diff")).alias("diff"), F.col("p_size").alias("created_at"), F.col("p_partkey").alias("id"))


def _few(s, d):
    parts = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    more = s.range(1).select(F.lit("no such brand").alias("standard"))
    wanted = parts.select(F.col("p_brand").alias("standard")).unionByName(more)
    # Configurations are compared after the newest rows are taken: they take no part in which those are.
    newest = newest_of(parts.withColumns({"created_at": F.col("p_size"), "id": F.col("p_partkey")}), 3, "p_brand")
    return few_shot_texts(wanted, _history(newest))


_TEMPLATE = "T {document_type}; S {detected_standard}; E {special_elements}; C {rag_context}; X {few_shot_examples}"


def _prompts(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    found = F.transform(F.sequence(F.lit(0), F.col("p_size") % 8), lambda k: F.concat(F.lit("r"), k.cast("string")))
    results = F.when(F.col("p_size") % 8 > 0, F.slice(found, 2, 9))
    special = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "包含复杂表格"), F.when(F.col("p_size") % 3 == 0, "包含数学公式"), F.when(F.col("p_size") % 5 == 0, "包含化学结构式")))
    kind = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
    standard = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("{rag_context}"), "p_brand"))
    return p.select("p_partkey", style_prompt(F.lit(_TEMPLATE), kind, standard, special, results, F.when(F.col("p_partkey") % 5 > 0, F.col("p_name"))).alias("prompt"))


def _merged(s, d):
    whole = _configs(s, d).select("p_partkey", merge_json(F.col("config"), F.col("other")).alias("merged"))
    return _with_kinds(flat_paths(whole, "p_partkey", "merged", 1))


def _with_kinds(paths: DataFrame) -> DataFrame:
    """Objects and lists by their kind alone."""
    v = F.col("value")
    return paths.withColumn("value", F.when(v.startswith("{"), "object").when(v.startswith("["), "array").otherwise(v))


QUERIES = {
    "validate_style": lambda s, d: _checked(s, d).select("p_partkey", F.array_join(fault_texts(F.col("faults")), "; ").alias("errors")),
    "style_fault_rollup": lambda s, d: fault_rollup(_checked(s, d)),
    "style_quarantine": _quarantined,
    "apply_style_defaults": _filled,
    "style_diff": lambda s, d: style_diff(_configs(s, d), "config", "other").select("p_partkey", "diff"),
    "merge_json_config": _merged,
    "style_paths": lambda s, d: _with_kinds(flat_paths(_configs(s, d), "p_partkey", "config")),
    "few_shot_block": _few,
    "assemble_prompt": _prompts,
}


# The twins in DuckDB's JSON functions.


def _sql_number(v: str) -> str:
    return (
        f"(CASE json_type({v}) WHEN 'VARCHAR' THEN TRY_CAST(trim({v} ->> '$') AS DOUBLE) WHEN 'BOOLEAN' THEN CAST(CAST({v} ->> '$' AS BOOLEAN) AS DOUBLE)"
        f" WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL ELSE TRY_CAST({v} ->> '$' AS DOUBLE) END)"
    )


def _quoted(message: str) -> str:
    return "'" + message.replace("'", "''") + "'"


def _sql_leaf(rule: Rule, v: str) -> str:
    """SQL of what is wrong with a plain value that is there and not null."""
    wrong = _quoted(allowed(rule.values) if rule.kind == "choice" else WRONG[rule.kind])
    unread = _quoted(WRONG.get(rule.kind, "") + UNREAD.get(rule.kind, ""))
    listed = lambda values: ", ".join(map(_quoted, values))
    if rule.kind == "text":
        return f"CASE WHEN json_type({v}) <> 'VARCHAR' THEN {wrong} END"
    if rule.kind == "choice":
        return f"CASE WHEN json_type({v}) <> 'VARCHAR' OR ({v} ->> '$') NOT IN ({listed(rule.values)}) THEN {wrong} END"
    if rule.kind == "flag":
        good = f"CASE json_type({v}) WHEN 'BOOLEAN' THEN true WHEN 'VARCHAR' THEN lower(trim({v} ->> '$')) IN ({listed(TRUE + FALSE)}) ELSE coalesce({_sql_number(v)} IN (0, 1), false) END"
        return f"CASE WHEN NOT ({good}) THEN CASE WHEN json_type({v}) IN ('OBJECT', 'ARRAY') THEN {wrong} ELSE {unread} END END"
    cases = [f"WHEN n IS NULL THEN CASE WHEN json_type({v}) = 'VARCHAR' THEN {unread} ELSE {wrong} END"]
    if rule.kind == "whole":
        cases.append(f"WHEN n <> floor(n) THEN CASE WHEN json_type({v}) = 'VARCHAR' THEN {unread} ELSE {_quoted(WRONG['whole'] + FRACTION)} END")
        cases += [f"WHEN n < {rule.low} THEN 'Input should be greater than or equal to {rule.low}'"] if rule.low is not None else []
        cases += [f"WHEN n > {rule.high} THEN 'Input should be less than or equal to {rule.high}'"] if rule.high is not None else []
    return f"list_transform([{_sql_number(v)}], lambda n: CASE {' '.join(cases)} END)[1]"


def _sql_errors(rule: Rule, x: str, path: str, depth: int = 0) -> str:
    """SQL of the list of {path, message} of a JSON value; path: SQL of its path with an arrow behind each name, and of the one before."""
    v, k = f"v{depth}", f"k{depth}"
    said = lambda m: f"[{{'path': {path}, 'message': {_quoted(m)}}}]"
    wrong = allowed(rule.values) if rule.kind == "choice" else WRONG[rule.kind]
    below = lambda name: name if path == "''" else f"{path} || '{ARROW}' || {name}"
    if rule.kind == "part":
        inside = [_sql_errors(r, f"json_extract({v}, '$.{n}')", below(f"'{n}'"), depth + 1) for n, r in rule.parts.items()]
        found = f"CASE WHEN json_type({v}) <> 'OBJECT' THEN {said(wrong)} ELSE flatten([{', '.join(inside)}]) END"
    elif rule.kind == "list":
        one = _sql_errors(rule.item.must(), f"json_extract({v}, '$[' || {k} || ']')", below(f"CAST({k} AS VARCHAR)"), depth + 1)
        found = f"CASE WHEN json_type({v}) <> 'ARRAY' THEN {said(wrong)} ELSE flatten(list_transform(range(CAST(json_array_length({v}) AS BIGINT)), lambda {k}: {one})) END"
    else:
        found = f"list_transform(list_filter([{_sql_leaf(rule, v)}], lambda m{depth}: m{depth} IS NOT NULL), lambda m{depth}: {{'path': {path}, 'message': m{depth}}})"
    null = "[]" if rule.optional else said(wrong)
    return f"list_transform([{x}], lambda {v}: CASE WHEN {v} IS NULL THEN {said(MISSING) if rule.required else '[]'} WHEN json_type({v}) = 'NULL' THEN {null} ELSE {found} END)[1]"


_CONFIGS = f"c AS MATERIALIZED (SELECT p_partkey, p_size, p_brand, {STYLE_JSON} AS config, {OTHER_JSON} AS other FROM part)"
_CHECKED = f"{_CONFIGS}, e AS MATERIALIZED (SELECT p_partkey, config, {_sql_errors(STYLE, chr(40) + 'coalesce(TRY_CAST(config AS JSON), CAST(' + chr(39) + 'null' + chr(39) + ' AS JSON)))', chr(39) * 2)} AS faults FROM c)"


def _sql_default(path: str) -> str:
    """SQL of a field with its default; null where its part is missing."""
    rule, above = STYLE, []
    for name in path.split("."):
        above.append((name, rule))
        rule = rule.parts[name]
    kind = {"number": "DOUBLE", "flag": "BOOLEAN", "whole": "BIGINT"}.get(rule.kind, "VARCHAR")
    default = "NULL" if rule.default is None else _quoted(str(rule.default))
    value = f"coalesce(CAST(json_extract_string(config, '$.{path}') AS {kind}), CAST({default} AS {kind}))"
    owner = path.rsplit(".", 1)[0]
    return value if owner == "page_layout" else f"CASE WHEN json_type(config, '$.{owner}') = 'OBJECT' THEN {value} END"


def _sql_shown(side: str, path: str) -> str:
    value = f"json_extract_string({side}, '$.{path}')"
    return f"CASE json_type({side}, '$.{path}') WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(left({value}, 1)) || substr({value}, 2) ELSE coalesce({value}, 'None') END"


def _sql_diff() -> str:
    said = []
    for group, where, name in COMPARED:
        path = f"{where}.{name}"
        a, b = (f"coalesce(json_extract({c}, '$.{path}'), CAST('null' AS JSON))" for c in ("x", "y"))
        same = f"CASE WHEN json_type({a}) IN ('VARCHAR', 'OBJECT', 'ARRAY') OR json_type({b}) IN ('VARCHAR', 'OBJECT', 'ARRAY') THEN CAST({a} AS VARCHAR) = CAST({b} AS VARCHAR) ELSE {_sql_number(a)} IS NOT DISTINCT FROM {_sql_number(b)} END"
        said.append(f"CASE WHEN NOT ({same}) THEN '{group}.{name}: ' || {_sql_shown('x', path)} || ' → ' || {_sql_shown('y', path)} END")
    there = lambda c: f"coalesce(json_type({c}) = 'OBJECT' AND len(json_keys({c})) > 0, false)"
    sides = "SELECT *, TRY_CAST(config AS JSON) AS x, TRY_CAST(other AS JSON) AS y FROM c"
    changes = f"concat_ws('; ', {', '.join(said)})"
    return f"h AS MATERIALIZED (SELECT *, CASE WHEN {there('x')} AND {there('y')} THEN coalesce(nullif({changes}, ''), '{SAME}') WHEN {there('y')} THEN '{CREATED}' ELSE '{DELETED}' END AS diff FROM ({sides}))"


_HEADING = "json_extract_string(config, '$.heading_styles[0]{}')"
_CANON = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '') ELSE CAST({0} AS VARCHAR) END"
_FIELDS = "SELECT p_partkey, unnest(json_keys({0})) AS path, {0} AS j FROM ({1}) WHERE json_type({0}) = 'OBJECT'"
_FEW = f"""
hist AS (SELECT p_brand AS standard, CASE WHEN p_size % 2 = 0 THEN 'chat' ELSE 'form' END AS source, config AS before, other AS after, CASE WHEN p_size % 7 > 0 THEN diff END AS diff, p_size, p_partkey FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY standard ORDER BY p_size DESC, p_partkey) AS n FROM hist),
t AS (SELECT standard, string_agg('- 调整来源: ' || source || chr(10) || '  差异: ' || diff || chr(10) || '  调整前: ' || left(before, 200) || '...' || chr(10) || '  调整后: ' || left(after, 200) || '...', chr(10) ORDER BY n)
      FILTER (diff <> '' AND before <> '' AND before <> '{{}}' AND after <> '' AND after <> '{{}}') AS x FROM r WHERE n <= 3 GROUP BY standard)
SELECT standard, coalesce(x, '{NO_EXAMPLE}') AS examples FROM t UNION ALL SELECT 'no such brand', '{NO_HISTORY}'"""
_PROMPT = f"""
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND p_type <> '' THEN p_type ELSE '通用文档' END AS kind, CASE WHEN p_partkey % 4 > 0 THEN '{{rag_context}}' || p_brand ELSE 'GB/T 9704' END AS standard,
     coalesce(nullif(concat_ws('、', CASE WHEN p_size % 2 = 0 THEN '包含复杂表格' END, CASE WHEN p_size % 3 = 0 THEN '包含数学公式' END, CASE WHEN p_size % 5 = 0 THEN '包含化学结构式' END), ''), '无特殊元素') AS special,
     CASE WHEN p_size % 8 > 0 THEN array_to_string(list_transform(range(1, least(p_size % 8, 5) + 1), lambda k: 'r' || k), chr(10) || chr(10)) ELSE '{NO_CONTEXT}' END AS found,
     CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '{NO_HISTORY}' END AS few FROM part)
SELECT p_partkey, 'T ' || kind || '; S ' || replace(standard, '{{rag_context}}', found) || '; E ' || special || '; C ' || found || '; X ' || few AS prompt FROM v"""
ORACLES = {
    "validate_style": f"WITH {_CHECKED} SELECT p_partkey, array_to_string(list_transform(faults, lambda f: '[' || f.path || '] ' || f.message), '; ') AS errors FROM e",
    "style_fault_rollup": rf"WITH {_CHECKED}, u AS (SELECT unnest(faults) AS f FROM e) SELECT regexp_replace(f.path, '( -> )\d+( -> |$)', '\1*\2', 'g') AS path, f.message AS message, count(*) AS errors FROM u GROUP BY ALL",
    "style_quarantine": f"WITH {_CHECKED} SELECT p_partkey, CASE WHEN len(faults) = 0 THEN 'sound' ELSE 'faulty' END AS part, len(faults) AS errors FROM e",
    "apply_style_defaults": f"WITH {_CHECKED} SELECT p_partkey, {', '.join(f'{_sql_default(c)} AS {c.replace(chr(46), chr(95))}' for c in _READ_BACK)}, CASE WHEN json_array_length(config, '$.heading_styles') > 0 THEN coalesce(CAST({_HEADING.format('.line_spacing')} AS DOUBLE), 1.5) END AS heading_line_spacing, "
    f"CASE WHEN json_array_length(config, '$.heading_styles') > 0 THEN coalesce(CAST({_HEADING.format('.font.italic')} AS BOOLEAN), false) END AS heading_italic, CAST({_HEADING.format('.level')} AS BIGINT) AS heading_level, CAST(coalesce(json_array_length(config, '$.heading_styles'), 0) AS BIGINT) AS headings, "
    "array_to_string(CAST(json_extract_string(config, '$.rag_sources[*]') AS VARCHAR[]), ',') AS sources FROM e WHERE len(faults) = 0",
    "style_diff": f"WITH {_CONFIGS}, {_sql_diff()} SELECT p_partkey, diff FROM h",
    "merge_json_config": f"WITH {_CONFIGS}, s AS (SELECT p_partkey, TRY_CAST(config AS JSON) AS x, TRY_CAST(other AS JSON) AS y FROM c), b AS ({_FIELDS.format('y', 'SELECT * FROM s')}), a AS ({_FIELDS.format('x', 'SELECT * FROM s')}), "
    f"u AS (SELECT p_partkey, path, json_extract(j, '$.' || path) AS v FROM b UNION ALL SELECT p_partkey, path, json_extract(j, '$.' || path) FROM a WHERE (p_partkey, path) NOT IN (SELECT (p_partkey, path) FROM b)) SELECT p_partkey, path, {_CANON.format('v')} AS value FROM u",
    "style_paths": f"WITH {_CONFIGS}, r AS (SELECT p_partkey, TRY_CAST(config AS JSON) AS v FROM c), a AS (SELECT p_partkey, path, json_extract(j, '$.' || path) AS v FROM ({_FIELDS.format('v', 'SELECT * FROM r')})), "
    "b AS (SELECT p_partkey, path || '.' || k AS path, json_extract(v, '$.' || k) AS v FROM (SELECT *, unnest(json_keys(v)) AS k FROM a WHERE json_type(v) = 'OBJECT')), d AS (SELECT p_partkey, path || '.' || k AS path, json_extract(v, '$.' || k) AS v FROM (SELECT *, unnest(json_keys(v)) AS k FROM b WHERE json_type(v) = 'OBJECT')) "
    f"SELECT p_partkey, path, {_CANON.format('v')} AS value FROM (SELECT * FROM a WHERE json_type(v) <> 'OBJECT' UNION ALL SELECT * FROM b WHERE json_type(v) <> 'OBJECT' UNION ALL SELECT * FROM d)",
    "few_shot_block": f"WITH {_CONFIGS}, {_sql_diff()}, {_FEW}",
    "assemble_prompt": _PROMPT,
}
