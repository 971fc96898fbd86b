"""Chat formatting: records of several layouts become marked-up conversations.

A record is a variant. Its nested field paths, without the types of the values,
are hashed; the hash selects a declarative mapping from the layout to canonical
turns (role, text). Turns are rendered by a template, with control strings in
texts escaped reversibly, and the spans of assistant texts are kept as the loss
mask. `read_back` restores turns and masked texts from the rendered string.

Defined results: a null text or role counts as empty. Turns that share a turn
number are ordered by role, then text; repeated rows are turns of their own. A
record of a layout without a mapping has the mapping `none` and null turns. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    `paths`: the layout's field paths, `[]` for array elements.
    `turns`: (role, path of the text) for each turn in order; a turn whose text
    is missing is left out. Or `items`: (path of the array, name of the role
    field, name of the text field) and `roles`, the layout's names of roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("shared", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("input", "instruction", "output"), turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction only", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
)


def shape(paths: tuple[str, ...]) -> str:
    """The shape of a layout as `field_shape` writes it: fields in order of their names, at most one level of array."""
    nested: dict[str, list[str]] = {}
    for path in sorted(paths):
        head, _, tail = path.partition("[].")
        nested.setdefault(head, []).extend([tail] if tail else [])
    return "{" + ",".join(f"{head}:[{{{','.join(f'{t}:_' for t in tails)}}}]" if tails else f"{head}:_" for head, tails in nested.items()) + "}"


def field_shape(record: Column) -> Column:
    """Nested field paths of a variant as one string; scalar types and nulls are alike."""
    text = F.schema_of_variant(record)
    text = F.regexp_replace(text, r"(?<=[:<] ?)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|BINARY|DATE|FLOAT|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\d+\))(?=[,>])", "_")
    text = F.regexp_replace(F.regexp_replace(text, "ARRAY<(_|OBJECT<[^<>]*>)>", "[$1]"), "OBJECT<([^<>]*)>", "{$1}")
    return F.regexp_replace(F.regexp_replace(text, "OBJECT<([^<>]*)>", "{$1}"), r"([:,]) ", "$1")


def fingerprint(record: Column) -> Column:
    return F.sha2(field_shape(record), 256)


def _known(mapping: Mapping) -> Column:
    return F.sha2(F.lit(shape(mapping.paths)), 256)


def _turns(record: Column, mapping: Mapping) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if mapping.items:
        path, role, text = mapping.items
        items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")

        def named(item: Column) -> Column:
            out = item[role]
            for given, canonical in mapping.roles:
                out = F.when(item[role] == given, F.lit(canonical)).otherwise(out)
            return out

        return F.transform(items, lambda i: turn(named(i), i[text]))
    return F.filter(
        F.array(*[F.struct(F.lit(role).alias("role"), F.try_variant_get(record, f"$.{path}", "string").alias("text")) for role, path in mapping.turns]),
        lambda t: t["text"].isNotNull(),
    )


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, mapping and turns to rows with a variant column."""
    with_print = records.withColumn("fingerprint", fingerprint(F.col(record)))
    name, turns = F.lit("none"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        hit = F.col("fingerprint") == _known(m)
        name, turns = F.when(hit, F.lit(m.name)).otherwise(name), F.when(hit, _turns(F.col(record), m).cast(TURNS)).otherwise(turns)
    return with_print.withColumn("mapping", name).withColumn("turns", turns)


def escape(text: Column) -> Column:
    """One backslash more in every `<`, backslashes, `|`: the result holds no `<|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render(turns: Column) -> Column:
    """The conversation as one string; roles are percent-encoded, since a line feed ends them."""
    part = F.transform(turns, lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")))
    return F.array_join(part, "")


def loss_spans(turns: Column) -> Column:
    """(start, end) of each assistant text in the rendered string: code points, end exclusive."""
    head, tail = len(START) + 1, len(END) + 1
    sized = F.transform(
        turns,
        lambda t: F.struct(
            (t["role"] == LOSS_ROLE).alias("loss"),
            (F.length(F.url_encode(t["role"])) + head).cast("long").alias("head"),
            F.length(escape(t["text"])).cast("long").alias("size"),
        ),
    )
    spans = F.aggregate(
        sized,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["head"] + t["size"] + tail).alias("at"),
            F.when(
                t["loss"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + t["head"]).alias("start"), (a["at"] + t["head"] + t["size"]).alias("end")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return spans["spans"]


def formatted(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint, mapping, turns, formatted and loss_spans."""
    turned = canonical(records, record)
    return turned.withColumn("formatted", render(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns")))


def read_back(text: Column) -> Column:
    """Turns of a rendered string."""
    parts = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - (len(END) + 2))
            ).alias("text"),
        ),
    )


def read_loss(text: Column, spans: Column) -> Column:
    """The text under the loss mask: each masked stretch unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
