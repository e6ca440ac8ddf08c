"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is known by its fingerprint, a hash of its sorted nested field paths.
The fingerprint selects a declarative mapping, which gives for each turn where
its role and its text are. So heterogeneous sources (prompt and completion,
instruction and input and output, lists of messages, one row a turn) become one
canonical column: turns, array<struct<role, text>>.

The template writes a turn as

    <|turn|>role<|text|>text<|end|>

Control strings inside roles and texts, these three and other templates' own,
get a backslash after their first character; those that have backslashes there
already get one more, so the escape can be undone. The loss mask is a list of
character spans of the formatted string, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of public chat templates, without their first character.
CONTROL = r"/?s>|/?INST\]|<SYS>>|</SYS>>|\|[^|<>\x09-\x0D\x20]+\|>|(?:start|end)_of_turn>|pad>|unk>|bos>|eos>"
OPEN = r"([<\[])"

TURNS = "array<struct<role:string,text:string>>"

#: Layouts: field paths and what makes turns of them. "[]" marks a list's elements.
#: A mapping is either a list of (role, field) or (list field, role field, text field, other names of roles).
LAYOUTS: list[tuple[tuple[str, ...], tuple]] = [
    (("prompt", "completion"), ("fields", [("user", "prompt"), ("assistant", "completion")])),
    (("prompt", "response"), ("fields", [("user", "prompt"), ("assistant", "response")])),
    (("system", "prompt", "response"), ("fields", [("system", "system"), ("user", "prompt"), ("assistant", "response")])),
    (("question", "answer"), ("fields", [("user", "question"), ("assistant", "answer")])),
    (("instruction", "output"), ("fields", [("user", "instruction"), ("assistant", "output")])),
    (("instruction", "input", "output"), ("fields", [("user", "instruction+input"), ("assistant", "output")])),
    (("messages[].role", "messages[].content"), ("list", "messages", "role", "content")),
    (("conversations[].from", "conversations[].value"), ("list", "conversations", "from", "value")),
    (("turn", "role", "text"), ("rows", "turn", "role", "text")),
]
#: Other names of roles in public data sets.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.StructType, ignore: tuple[str, ...] = ()) -> list[str]:
    """Sorted nested paths of a schema's leaves."""

    def walk(kind: T.DataType, at: str) -> list[str]:
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{at}[]")
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{at}.{f.name}" if at else f.name)]
        return [at]

    return sorted(p for p in walk(schema, "") if p.split(".")[0].removesuffix("[]") not in ignore)


def fingerprint(paths) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def mapping_for(schema: T.StructType, ignore: tuple[str, ...] = ()) -> tuple:
    """The mapping whose layout's paths are the schema's. If it has others
    besides (extra columns), the largest layout that it contains."""
    paths = field_paths(schema, ignore)
    if found := MAPPINGS.get(fingerprint(paths)):
        return found
    inside = [p for p, _ in LAYOUTS if set(p) <= set(paths)]
    if not inside:
        raise ValueError(f"no layout for the fields {', '.join(paths)}")
    return MAPPINGS[fingerprint(max(inside, key=len))]


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns. Null texts are empty; null roles are empty; null entries of
    lists and null lists are no turns. One row a turn: grouped by key, in order
    of turn, null turns first, equal turns in order of role and text; null keys
    form one conversation. Other columns are left out."""
    kind, *how = mapping_for(df.schema, (key,))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    turn = lambda role, said: F.struct(role.alias("role"), said.alias("text"))
    if kind == "fields":

        def said(path: str) -> Column:
            parts = [text(F.col(p)) for p in path.split("+")]
            return parts[0] if len(parts) == 1 else F.when(parts[1] == "", parts[0]).otherwise(F.concat(parts[0], F.lit("\n"), parts[1]))

        return df.select(key, F.array(*(turn(F.lit(r), said(p)) for r, p in how[0])).cast(TURNS).alias("turns"))
    if kind == "list":
        field, role, said = how
        name = lambda r: F.coalesce(*(F.when(r == k, F.lit(v)) for k, v in ROLES.items()), r, F.lit(""))
        turns = F.transform(F.filter(F.coalesce(F.col(field), F.array().cast(df.schema[field].dataType)), lambda m: m.isNotNull()), lambda m: turn(name(m[role].cast("string")), text(m[said])))
        return df.select(key, turns.cast(TURNS).alias("turns"))
    order, role, said = how
    rows = df.select(key, F.struct(F.col(order).alias("at"), text(F.col(role)).alias("role"), text(F.col(said)).alias("text")).alias("turn"))
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list("turn")).alias("all"))
    return rows.select(key, F.transform("all", lambda m: turn(m["role"], m["text"])).cast(TURNS).alias("turns"))


def record_paths(record: Column) -> Column:
    """Sorted field paths of one row's JSON object: its keys, and of lists that a
    layout knows the keys of the first entry. Null if it is no object."""
    top = F.json_object_keys(record)
    lists = sorted({p.split("[]")[0] for paths, _ in LAYOUTS for p in paths if "[]" in p})
    held = F.filter(top, lambda k: ~k.isin(lists))
    for field in lists:
        keys = F.json_object_keys(F.get_json_object(record, f"$.{field}[0]"))
        inner = F.when(keys.isNotNull(), F.transform(keys, lambda k: F.concat(F.lit(f"{field}[]."), k))).otherwise(F.array(F.lit(f"{field}[]")))  # noqa: B023
        held = F.concat(held, F.when(F.array_contains(top, field), inner).otherwise(F.array().cast("array<string>")))
    return F.array_sort(held)


def canonical_records(df: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """key, turns, layout of rows that hold a conversation each as a JSON object,
    every row of a layout of its own. The fingerprint of its field paths selects
    the mapping; with further fields, the largest layout that it contains.

    A row of no known layout, or that is no object, has null turns and layout; a
    list without entries has no turns. Null texts and roles are empty. An empty
    table gives an empty result; repeated rows have a result each.
    """
    known = [(paths, how) for paths, how in LAYOUTS if how[0] != "rows"]
    rows = df.select(F.col(key), F.col(record).cast("string").alias("record")).withColumn("paths", record_paths(F.col("record")))
    rows = rows.withColumn("print", F.sha2(F.array_join("paths", "\n"), 256))
    largest = sorted(known, key=lambda x: -len(x[0]))
    inside = [F.when(F.size(F.array_except(F.array(*map(F.lit, paths)), "paths")) == 0, F.lit(fingerprint(paths))) for paths, _ in largest]
    empty = [F.when(F.array_contains("paths", f"{how[1]}[]"), F.lit(fingerprint(paths))) for paths, how in known if how[0] == "list"]
    rows = rows.withColumn("layout", F.coalesce(F.when(F.col("print").isin([fingerprint(p) for p, _ in known]), F.col("print")), *inside, *empty))
    field = lambda name: F.coalesce(F.get_json_object("record", f"$.{name}"), F.lit(""))
    turn = lambda role, said: F.struct(role.alias("role"), said.alias("text"))
    found = []
    for paths, (kind, *how) in known:
        if kind == "fields":
            joined = lambda path: F.when(field(path.split("+")[-1]) == "", field(path.split("+")[0])).otherwise(F.concat_ws("\n", *map(field, path.split("+"))))
            turns = F.array(*(turn(F.lit(r), joined(p)) for r, p in how[0]))
        else:
            entries = F.from_json(F.get_json_object("record", f"$.{how[0]}"), "array<map<string,string>>")
            name = lambda r: F.coalesce(*(F.when(r == k, F.lit(v)) for k, v in ROLES.items()), r, F.lit(""))
            turns = F.transform(F.filter(F.coalesce(entries, F.array().cast("array<map<string,string>>")), lambda m: m.isNotNull()), lambda m: turn(name(F.try_element_at(m, F.lit(how[1]))), F.coalesce(F.try_element_at(m, F.lit(how[2])), F.lit(""))))  # noqa: B023
        found.append(F.when(F.col("layout") == fingerprint(paths), turns.cast(TURNS)))
    return rows.select(key, F.coalesce(*found).alias("turns"), "layout")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"{OPEN}(\\*)(?={CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"{OPEN}\\(\\*)(?={CONTROL})", "$1$2")


def formatted(df: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """key, formatted, loss: array<struct<start, length>> of code points from 0,
    one for each text of role `learn`, in order."""
    parts = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(TURN), escaped(m["role"]), F.lit(TEXT)).alias("head"), escaped(m["text"]).alias("text")))
    state = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p["head"]) + F.char_length(p["text"]) + len(END)).alias("at"),
            F.when(p["role"] == learn, F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["text"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return df.select(key, parts.alias("parts")).select(key, whole.alias("formatted"), state["spans"].alias("loss"))


def parsed(text: Column) -> Column:
    """turns of a formatted string. Marks inside texts are escaped, so every
    mark that stands there is the template's own."""
    pieces = F.filter(F.split(text, r"\Q" + TURN + r"\E"), lambda p: p != "")
    cut = lambda p: F.split(F.substring(p, F.lit(1), F.char_length(p) - len(END)), r"\Q" + TEXT + r"\E", 2)
    return F.transform(F.transform(pieces, cut), lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def under_mask(text: Column, loss: Column) -> Column:
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def op10(conversations: DataFrame) -> DataFrame:
    """Of every conversation, and of -1, what its formatted string says. An empty
    table gives the row of -1 alone; other columns are left out."""
    said = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    out = formatted(canonical(rows)).select("conv_id", "formatted", "loss", parsed(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss")).alias("learned"))
    flat = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.lit(fingerprint(["turn", "role", "text"])).alias("layout"),
    )
