"""Scalar, path, name and record functions over fact columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dtype

#: Response classes that carry no shape of their own.
RESPONSE_CLASSES = (
    "Illuminate\\Http\\JsonResponse",
    "Illuminate\\Http\\Response",
    "Symfony\\Component\\HttpFoundation\\JsonResponse",
    "Symfony\\Component\\HttpFoundation\\Response",
)
#: Classes whose values may be left out of a rendered body.
OMISSION_MARKERS = ("Spatie\\LaravelData\\Optional", "Spatie\\LaravelData\\Lazy")
#: Credential words in constant names and what to call such a constant; the first that fits wins.
CREDENTIALS = (
    ("client_?secret", "a client secret"),
    ("api_?key", "an API key"),
    ("private_?key", "a private key"),
    ("passw(or)?d|passphrase", "a password"),
    ("secret", "a secret"),
    ("token", "a token"),
    ("credential", "a credential"),
)
MEMORY_HEADROOM = 0.7
FALLBACK_STATUS = 500


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ------------------------------------------------------------ paths and files


def under(path: Column, root: Column) -> Column:
    """Segment-wise prefix: the root itself or anything below it."""
    root = F.rtrim(root, F.lit("/"))
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def is_project_file(path: Column, roots: Column) -> Column:
    """below any of the roots (array); null and empty paths are not."""
    return _yes((path != "") & F.exists(roots, lambda r: under(path, r)))


def is_vendor_file(path: Column, root: Column) -> Column:
    """without a configured root every file counts as vendor."""
    return F.when(root.isNull() | (root == ""), F.lit(True)).otherwise(_yes(under(path, root)))


def follow_beyond_project(opted_in: Column, path: Column, vendor_root: Column, accepts: Column) -> Column:
    """The visitor opts in, the file is not vendor, its return-type predicate accepts."""
    return _yes(opted_in) & ~is_vendor_file(path, vendor_root) & _yes(accepts)


def can_fold_callee(path: Column, caller_path: Column, roots: Column, vendor_root: Column, follows: Column) -> Column:
    """F19."""
    return is_project_file(path, roots) | (~is_vendor_file(path, vendor_root) & (path == caller_path)) | _yes(follows)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no empty or dot segments, parent segments resolved."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def written_location(trait_file: Column, scope_file: Column, pos: Column, line: Column) -> Column:
    """The trait's file where the node came from one; a negative position is none."""
    return F.struct(F.coalesce(trait_file, scope_file).alias("file"), line.alias("line"), F.when(pos >= 0, pos).alias("pos"))


def source_order(pos: Column) -> Column:
    """Byte offset; a missing one sorts last."""
    return F.when(pos >= 0, pos.cast("long")).otherwise(F.lit(9223372036854775807))


# ------------------------------------------------------------ names


def short_name(fqcn: Column) -> Column:
    """The last segment of a namespaced name."""
    return F.element_at(F.split(fqcn, r"\\"), -1)


def self_label(fqcn: Column, method: Column) -> Column:
    """P13."""
    return F.concat(short_name(fqcn), F.lit("::"), method)


def frame(label: Column, file: Column, line: Column) -> Column:
    """P13."""
    return F.struct(label.alias("label"), file.alias("file"), line.alias("line"))


def scope_key(cls: Column, function: Column) -> Column:
    """Class::function, the function alone outside a class, null outside a function."""
    return F.when(function.isNotNull(), F.concat_ws("::", cls, function))


def constant_name(name: Column, dynamic: Column) -> Column:
    """last identifier of a constant, null if it is computed."""
    return F.when(~_yes(dynamic), short_name(name))


def credential_label(name: Column) -> Column:
    """What a constant's name says it holds, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in CREDENTIALS:
        out = out.when(F.lower(name).rlike(f"(^|_)({pattern})s?(_|$)"), F.lit(label))
    return out


def sensitive_label(operands: Column) -> Column:
    """the label of the first operand (array of constant names that can reach the value) that has one."""
    return F.get(F.filter(F.transform(operands, credential_label), lambda x: x.isNotNull()), F.lit(0))


def value_operands(kind: Column, cond: Column, left: Column, right: Column) -> Column:
    """children that can be the value: both sides of a concatenation, coalescing or ternary; a short ternary's condition is its value."""
    both = F.when(kind.isin("concat", "coalesce"), F.array(left, right)).when(kind == "ternary", F.array(F.coalesce(left, cond), right))
    return F.filter(F.coalesce(both, F.array().cast("array<string>")), lambda x: x.isNotNull())


def neon_string(s: Column) -> Column:
    """Single quotes doubled, within single quotes."""
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def major_minor(version: Column) -> Column:
    """The first two numbers, (0, 0) if there are none."""
    part = lambda k: F.coalesce(F.regexp_extract(version, r"(\d+)\.(\d+)", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))


def in_supported_range(version: Column, lowest: tuple[int, int], highest: tuple[int, int]) -> Column:
    """X15."""
    at = major_minor(version)
    number = at["major"] * 1000 + at["minor"]
    return number.between(lowest[0] * 1000 + lowest[1], highest[0] * 1000 + highest[1])


def memory_ceiling(text: Column) -> Column:
    """Bytes that a size such as ``512M`` leaves under the headroom; null where it sets none."""
    t = F.lower(F.trim(text))
    unit = F.regexp_extract(t, "([kmg])$", 1)
    number = F.when(unit != "", F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("decimal(38,0)")
    value = F.when(number.rlike("^[0-9]{1,18}$"), number).try_cast("decimal(38,0)") * scale
    return F.when(value <= F.lit("9223372036854775807").cast("decimal(38,0)"), F.floor(value * F.lit("0.7").cast("decimal(2,1)"))).cast("long")


# ------------------------------------------------------------ predicates


def concrete_classes(types: Column) -> Column:
    """without the two types that say nothing."""
    return F.filter(types, lambda t: ~t.isin("Throwable", "Exception"))


def is_bare_throwable(types: Column) -> Column:
    """F6."""
    return F.size(concrete_classes(types)) == 0


def is_response_class(fqcn: Column) -> Column:
    """F8."""
    return _yes(fqcn.isin(*RESPONSE_CLASSES))


def is_documentable(payload: Column, status: Column, content_type: Column) -> Column:
    """any of the three says something."""
    return payload.isNotNull() | status.isNotNull() | content_type.isNotNull()


def may_be_omitted(arms: Column) -> Column:
    """``arms`` is array<array<string>>, each arm's class with its supertypes; a marker or its subclass in any."""
    markers = F.array(*[F.lit(m) for m in OMISSION_MARKERS])
    return F.exists(arms, lambda supers: F.arrays_overlap(supers, markers))


def renders_value(kind: Column, is_null: Column, omissible: Column) -> Column:
    """an identity accessor whose value is provably neither null nor left out (``is_null`` is yes, maybe or no)."""
    return _yes(kind == "Identity") & _yes(is_null == "no") & ~_yes(omissible)


def accessor_equals(a: Column, b: Column) -> Column:
    """F16: all three fields, null-safe."""
    return a["param"].eqNullSafe(b["param"]) & a["kind"].eqNullSafe(b["kind"]) & a["method"].eqNullSafe(b["method"])


def has_variable_argument(args: Column) -> Column:
    """a plain variable before the first spread; args is array<struct<unpack, var_name>> in order."""
    spread = F.array_position(F.transform(args, lambda a: _yes(a["unpack"])), True)
    head = F.when(spread > 0, F.slice(args, F.lit(1), (spread - 1).cast("int"))).otherwise(args)
    return F.exists(head, lambda a: a["var_name"].isNotNull())


def within_depth(depth: Column, most: Column) -> Column:
    """F21."""
    return depth <= most


def within_budget(files: Column, file: Column, most: Column) -> Column:
    """a file that was touched before is free."""
    return F.array_contains(files, file) | (F.size(files) < most)


def affordable(depth: Column, used: Column, most: Column, files: Column, entry_files: Column, budget: Column) -> Column:
    """a stored answer fits if its levels and its files still do."""
    return (depth + used <= most) & (F.size(F.array_union(files, entry_files)) <= budget)


def inherited_unchanged(method_file: Column, class_file: Column) -> Column:
    """the method is written elsewhere than its class, so it was not overridden."""
    return ~method_file.eqNullSafe(class_file)


# ------------------------------------------------------------ arguments and statuses


def fold_status_arg(args: Column, slot: Column) -> Column:
    """The constant integer at the slot; null behind a spread or if it does not fold. args: array<struct<unpack, const>>."""
    spread = F.array_position(F.transform(args, lambda a: _yes(a["unpack"])), True)
    visible = (spread == 0) | (slot + 1 < spread)
    return F.when(visible & (slot >= 0), F.get(args, slot)["const"].try_cast("int"))


def default_if_absent(known: Column, folded: Column, present: Column, default: int) -> Column:
    """T5: the default holds only where the argument is provably absent."""
    return F.when(present, folded).when(known, F.lit(default))


def resolve_status(literal: Column, accessor: Column) -> Column:
    """A literal, else the accessor it is read from, else neither."""
    return F.struct(literal.alias("status"), F.when(literal.isNull(), accessor).alias("status_source"))


def content_type_of(items: Column) -> Column:
    """Value of the first item with that key (any case) and a constant value; items is array<struct<key, value>>."""
    return F.get(F.filter(items, lambda i: _yes((F.lower(i["key"]) == "content-type") & i["value"].isNotNull())), F.lit(0))["value"]


ACCESSOR = "struct<param: string, kind: string, method: string>"


def accessor(kind: Column, var: Column, member: Column, n_args: Column) -> Column:
    """Reads of a parameter: itself, its value, its name, or a method without arguments; else null."""
    kinds = F.when(kind == "variable", "Identity").when((kind == "property") & (member == "value"), "Value").when((kind == "property") & (member == "name"), "Name").when((kind == "call") & (n_args == 0), "Method")
    return F.when(kinds.isNotNull() & var.isNotNull(), F.struct(var.alias("param"), kinds.alias("kind"), F.when(kinds == "Method", member).alias("method")))


def provenance_from_array(items: Column) -> Column:
    """Map of literal string keys to accessors (array<struct<key, accessor>>); of equal keys the last wins."""
    named = F.transform(F.filter(items, lambda i: i["key"].isNotNull() & i["accessor"].isNotNull()), lambda i, k: F.struct(i["key"].alias("key"), i["accessor"].alias("accessor"), k.alias("at")))
    last = F.filter(named, lambda i: ~F.exists(named, lambda x: (x["key"] == i["key"]) & (x["at"] > i["at"])))
    return F.map_from_entries(F.transform(last, lambda i: F.struct(i["key"], i["accessor"])))


def fold_accessor_argument(kind: Column, literal: Column, sensitive: Column, backing: Column, case: Column, method: Column) -> Column:
    """X11: identity gives the literal unless it is sensitive; enum accessors give their folded value."""
    return F.when(kind == "Identity", F.when(~_yes(sensitive), literal)).when(kind == "Value", backing).when(kind == "Name", case).when(kind == "Method", method)


# ------------------------------------------------------------ response records

FIELD = "struct<key: string, type: string, optional: boolean>"


def replace_field_type(fields: Column, key: Column, new_type: Column) -> Column:
    """One field's type; the others and the order stay."""
    return F.transform(fields, lambda f: F.when(f["key"] == key, f.withField("type", new_type)).otherwise(f))


def settle_field(fields: Column, key: Column) -> Column:
    """The field is no longer optional; nothing ever makes one optional again."""
    return F.transform(fields, lambda f: F.when(f["key"] == key, f.withField("optional", F.lit(False))).otherwise(f))


def without_member(fields: Column, key: Column) -> Column:
    """U8."""
    return F.filter(fields, lambda f: f["key"] != key)


def mark_status_members(fields: Column, provenance: Column, status_source: Column) -> Column:
    """Members read from where the status is read echo it."""
    same = lambda f: _yes(accessor_equals(F.try_element_at(provenance, f["key"]), status_source)) & status_source.isNotNull()
    return F.transform(fields, lambda f: F.when(same(f), f.withField("type", dtype.status_marker())).otherwise(f))


def bind_member(fields: Column, provenance: Column, key: Column, literal: Column, rehomed: Column, renders: Column) -> tuple[Column, Column]:
    """Fields and provenance after a call site binds one member.

    A literal pins the type and ends the provenance, a re-homed accessor
    replaces it, and an argument that surely renders clears the optional flag.
    """
    pinned = F.when(literal.isNotNull(), replace_field_type(fields, key, dtype.literal(literal))).otherwise(fields)
    settled = F.when(_yes(renders), settle_field(pinned, key)).otherwise(pinned)
    rest = F.map_filter(provenance, lambda k, _: k != key)
    moved = F.when(literal.isNull() & rehomed.isNotNull(), F.map_concat(rest, F.create_map(key, rehomed))).otherwise(rest)
    return settled, moved


def with_status_source(record: Column, source: Column) -> Column:
    """Naming the source of a status clears the status."""
    return record.withField("status_source", source).withField("status", F.lit(None).cast("int"))


def with_bound_status(record: Column, status: Column) -> Column:
    """Binding a status ends its source."""
    return record.withField("status", status).withField("status_source", F.lit(None).cast(ACCESSOR))


def delegated(record: Column) -> Column:
    """A record that only says that it delegates."""
    return record.withField("delegates", F.lit(True))


def type_args(payload: Column, status: Column, content_type: Column, members: Column) -> Column:
    """P10: the generic arguments; unknowns hold places that something later needs."""
    some = is_documentable(payload, status, content_type)
    head = F.array(F.coalesce(payload, dtype.unknown(dtype.REASONS["payload"])), F.coalesce(dtype.literal(status.cast("string")), dtype.unknown(dtype.REASONS["status"])))
    held = F.when(content_type.isNotNull(), F.array(dtype.literal(dtype.json_text(content_type)))).when(members.isNotNull(), F.array(dtype.unknown(dtype.REASONS["content_type"]))).otherwise(F.array().cast("array<string>"))
    tail = F.when(members.isNotNull(), F.array(members)).otherwise(F.array().cast("array<string>"))
    return F.when(some, F.concat(head, held, tail))


def from_type_args(class_json: Column) -> Column:
    """Payload, status and content type out of a generic class; other kinds of argument are dropped."""
    arg = lambda k: F.get(F.from_json(F.get_json_object(class_json, "$.args"), "array<string>"), F.lit(k))
    value = lambda k: F.get_json_object(arg(k), "$.value")
    raw = lambda k: F.regexp_extract(arg(k), r'"value":("?)', 1)
    return F.struct(dtype.documentable_payload(arg(0)).alias("payload"), F.when(raw(1) == "", value(1).try_cast("int")).alias("status"), F.when(raw(2) == '"', value(2)).alias("content_type"))


def site_shape(has_expr: Column, is_response: Column, is_new: Column, rich: Column, refined: Column, delegates: Column, plain: Column) -> Column:
    """Void without an expression; other types pass; a rich response stands unless it is built here; else the refined one."""
    return F.when(~has_expr, dtype.void_type()).when(~_yes(is_response), plain).when(rich.isNotNull() & ~_yes(is_new), rich).when(_yes(delegates), dtype.void_type()).otherwise(F.coalesce(refined, rich, plain))
