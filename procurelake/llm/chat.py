"""Chat formatting: conversations of any known layout into one template, by DataFrame functions only.

A record's layout is known by its fingerprint: the hash of those of its nested field paths that any
mapping names, sorted. The fingerprint selects a declarative mapping (where the turns are, which
field is the role and which the text, or which fields stand for which role); where it is that of
fields of two layouts at once, the first mapping whose fields are all there is taken. Further fields
don't matter. `canonical` takes a struct column, whose records may differ in which fields are not
null, as in a file of mixed records; `canonical_json` takes JSON texts (those of over 16 MB have no
paths, use `canonical` for them).

The template writes a turn as `<turn>role<text>text</turn>` and a line feed. In roles and texts
the characters `\\`, `<` and `#` are written as `\\b`, `\\l` and `\\h`: no control string can occur
inside a text, and reading replaces the three pairs again. Loss spans are (start, length) in code
points of the formatted string, one for each assistant turn, over its text alone.

Roles stay as they are, except where a mapping has names of its own for them. Null texts and roles
are empty; an optional field that is null or empty is no turn. A conversation whose turns are null
or empty has none and an empty format. Turns with equal numbers are ordered by role and text. A
layout that no mapping knows gives null turns, with the fingerprint of all its paths kept for
review; a struct that no mapping can fit is an error. Repeated rows and further columns stay.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: Characters of the template that a text may hold, and what stands for them.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"

#: Names of roles in lists of `from` and `value`.
NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Declarative mappings. `list` with `role`, `text` (`order`, `names`): an array of turns. `fields`: (path, role) in order, of which some are `optional`.
MAPPINGS: tuple[dict, ...] = (
    {"list": "turns", "role": "role", "text": "text", "order": "turn"},
    {"list": "messages", "role": "role", "text": "content"},
    {"list": "conversations", "role": "from", "text": "value", "names": NAMES},
    {"fields": (("system", "system"), ("prompt", "user"), ("response", "assistant")), "optional": ("system",)},
    {"fields": (("system", "system"), ("prompt", "user"), ("completion", "assistant")), "optional": ("system",)},
    {"fields": (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), "optional": ("system", "input")},
    {"fields": (("question", "user"), ("answer", "assistant"))},
)


def paths_of(mapping: dict) -> tuple[list[str], list[str]]:
    """(field paths that a mapping needs, paths that it also reads)."""
    if "list" in mapping:
        at = lambda k: f"{mapping['list']}[].{mapping[k]}"
        return [at("role"), at("text")], [at("order")] if "order" in mapping else []
    more = list(mapping.get("optional", ()))
    return [p for p, _ in mapping["fields"] if p not in more], more


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: All paths that mappings name, and a mapping's number by each fingerprint that it is for.
NAMED = sorted({p for m in MAPPINGS for ps in paths_of(m) for p in ps})
KNOWN = {fingerprint([*need, *some]): i for i, (need, more) in enumerate(map(paths_of, MAPPINGS)) for n in range(len(more) + 1) for some in itertools.combinations(more, n)}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested field paths of a type; an element of an array is `[]`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def _chosen(paths: Column, print_: Column, also: list[int]) -> Column:
    """The number of the mapping for a record's paths; of `also`, those that fit in part."""
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv]), print_)
    empty = [F.array_contains(paths, f"{m['list']}[]") if "list" in m else F.lit(False) for m in MAPPINGS]
    whole = [F.when((F.size(F.array_except(_strings(paths_of(m)[0]), paths)) == 0) | e, F.lit(i)) for i, (m, e) in enumerate(zip(MAPPINGS, empty))]
    part = [F.when(F.arrays_overlap(_strings(paths_of(MAPPINGS[i])[0]), paths), F.lit(i)) for i in also]
    return F.coalesce(exact, *whole, *part)


def _print(paths: Column) -> Column:
    own = F.array_intersect(paths, _strings(NAMED))
    return F.sha2(F.array_join(F.array_sort(F.when(F.size(own) > 0, own).otherwise(paths)), "\n").cast("binary"), 256)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column, names: dict) -> Column:
    if not names:
        return _text(c)
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(named, _text(c)), _text(c))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _apply(mapping: dict, at: Column, there: list[str]) -> Column:
    """Canonical turns of a struct column that has the paths `there`."""
    need, more = paths_of(mapping)
    if "list" not in mapping:
        turn = lambda p, r: _turn(F.lit(r), _text(at[p]))
        turns = [F.when(_text(at[p]) != "", turn(p, r)) if p in more else turn(p, r) for p, r in mapping["fields"] if p in there]
        return F.filter(F.array(*turns), lambda t: t.isNotNull()).cast(TURNS)
    role, text, order, names = mapping["role"], mapping["text"], mapping.get("order"), mapping.get("names", {})
    own = at[mapping["list"]]
    if order and more[0] in there:
        own = F.array_sort(F.transform(own, lambda t: F.struct(t[order].alias("order"), _text(t[role]).alias(role), _text(t[text]).alias(text))))
    return F.coalesce(F.transform(own, lambda t: _turn(_role(t[role], names), _text(t[text]))), F.array().cast(TURNS))


def canonical(df: DataFrame, record: str, into: str = "canonical", print_: str = "fingerprint") -> DataFrame:
    """df with the fingerprint and the canonical turns of a struct column; a record has the paths of its fields that are not null."""
    kind = df.schema[record].dataType
    there = schema_paths(kind)
    fit = [i for i, m in enumerate(MAPPINGS) if set(paths_of(m)[0]) <= set(there)]
    if not fit:
        raise ValueError(f"no mapping for fields {there}")
    own = [F.when(F.col(record)[f.name].isNotNull(), _strings(schema_paths(T.StructType([f])))).otherwise(_strings([])) for f in kind.fields]
    paths = F.concat(*own)
    df = df.withColumn(print_, F.when(F.col(record).isNotNull(), _print(paths)))
    which = _chosen(paths, F.col(print_), fit)
    turns = F.coalesce(*[F.when(which == i, _apply(MAPPINGS[i], F.col(record), there)) for i in fit])
    return df.withColumn(into, turns)


#: Parts of a variant's schema such as OBJECT<a: ARRAY<OBJECT<`b c`: STRING>>>: names, brackets, types.
_PARTS = r"(`[^`]*+(?:``[^`]*+)*+`: |[^ <>:,`()]+: |OBJECT<|ARRAY<|>|[A-Z][A-Z_0-9]*+(?:\([0-9,]+\))?)"


def json_paths(record: Column) -> Column:
    """All nested field paths of a JSON record, of lists the union of their elements'; names that are no words are in backquotes."""
    parts = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(record)), F.lit(_PARTS), F.lit(1))
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit("").alias("at"), none.alias("open"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at, open_, out = acc["at"], acc["open"], acc["out"]
        last = F.coalesce(F.try_element_at(open_, F.lit(-1)), F.lit(""))
        state = lambda a, b, c: F.struct(a.alias("at"), b.alias("open"), c.alias("out"))
        name = F.substring_index(x, ": ", 1)
        return (
            F.when(x == "OBJECT<", state(at, F.concat(open_, F.array(at)), out))
            .when(x == "ARRAY<", state(F.concat(at, F.lit("[]")), F.concat(open_, F.array(at)), out))
            .when(x == ">", state(last, F.slice(open_, F.lit(1), F.greatest(F.size(open_) - 1, F.lit(0))), out))
            .when(x.endswith(": "), state(F.when(last == "", name).otherwise(F.concat(last, F.lit("."), name)), open_, out))
            .otherwise(state(at, open_, F.concat(out, F.array(at))))
        )

    return F.array_sort(F.array_distinct(F.coalesce(F.aggregate(parts, zero, step)["out"], none)))


def canonical_json(df: DataFrame, record: str, into: str = "canonical", print_: str = "fingerprint") -> DataFrame:
    """df with the fingerprint and the canonical turns of a column of JSON records of mixed layouts."""
    df = df.withColumn("__paths", json_paths(F.col(record)))
    df = df.withColumn(print_, _print(F.col("__paths")))
    which = _chosen(F.col("__paths"), F.col(print_), [])
    turns = []
    for i, m in enumerate(MAPPINGS):
        if "list" in m:
            item = [T.StructField(m[k], T.LongType() if k == "order" else T.StringType()) for k in ("role", "text", "order") if k in m]
            kind = T.StructType([T.StructField(m["list"], T.ArrayType(T.StructType(item)))])
        else:
            kind = T.StructType([T.StructField(p, T.StringType()) for p, _ in m["fields"]])
        turns.append(F.when(which == i, _apply(m, F.from_json(F.col(record), kind), schema_paths(kind))))
    return df.withColumn(into, F.coalesce(*turns)).drop("__paths")


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(df: DataFrame, turns: str = "canonical", formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """df with the formatted conversation and its loss spans."""
    own = F.coalesce(F.col(turns), F.array().cast(TURNS))
    pieces = F.transform(own, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE)))
    df = df.withColumn(formatted, F.array_join(pieces, ""))
    head, tail = F.lit(len(OPEN) + len(MIDDLE)), F.lit(len(CLOSE))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(escape(t["role"])) + head
        n = F.length(escape(t["text"]))
        span = F.struct(start.cast("long").alias("start"), n.cast("long").alias("length"))
        more = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + n + tail).cast("long").alias("at"), more.alias("spans"))

    return df.withColumn(spans, F.aggregate(own, zero, step)["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: _turn(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)), unescape(F.substring_index(p, MIDDLE, -1))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def gathered(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record for each conversation of a table of turns, in the layout of a list of numbered turns."""
    turn = F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return df.groupBy(key).agg(F.collect_list(turn).alias("turns")).select(key, F.struct("turns").alias("record"))


def mixed(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Records of `gathered` in the layouts that they fit, as a struct in which the fields of other layouts are null.

    Two turns may be a prompt and its response or an instruction and its output, with a system text before
    them; all others are lists under one of three names. A hash of the key chooses."""
    own = F.array_sort(F.transform("record.turns", lambda t: F.struct(t["turn"].alias("turn"), _text(t["role"]).alias("role"), _text(t["text"]).alias("text"))))
    df = df.withColumn("__turns", own).withColumn("__n", F.pmod(F.xxhash64(key), F.lit(3)))
    turns, n = F.col("__turns"), F.col("__n")
    roles = F.transform(turns, lambda t: t["role"])
    headed = (roles == _strings(["system", "user", "assistant"])) & (F.get(turns, F.lit(0))["text"] != "")
    pair = headed | (roles == _strings(["user", "assistant"]))
    layout = F.when(pair & (n == 0), "prompt").when(pair & (n == 1), "instruction").otherwise(F.element_at(_strings(["turns", "messages", "conversations"]), (n + 1).cast("int")))
    df = df.withColumn("__layout", layout).withColumn("__headed", headed)
    is_ = lambda x: F.col("__layout") == x
    back = lambda k: F.get(turns, F.size(turns) - k)["text"]
    record = F.struct(
        F.col(key).cast("string").alias("id"),
        F.when(is_("turns"), turns).alias("turns"),
        F.when(is_("messages"), F.transform(turns, lambda t: F.struct(t["text"].alias("content"), t["role"].alias("role"), t["turn"].alias("index")))).alias("messages"),
        F.when(is_("conversations"), F.transform(turns, lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))).alias("conversations"),
        F.when(F.col("__headed") & (is_("prompt") | is_("instruction")), F.get(turns, F.lit(0))["text"]).alias("system"),
        F.when(is_("prompt"), back(2)).alias("prompt"),
        F.when(is_("prompt"), back(1)).alias("response"),
        F.when(is_("instruction"), back(2)).alias("instruction"),
        F.when(is_("instruction"), F.lit("")).alias("input"),
        F.when(is_("instruction"), back(1)).alias("output"),
    )
    return df.withColumn("record", record).drop("__turns", "__n", "__layout", "__headed")
