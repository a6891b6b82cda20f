"""Chat formatting by schema fingerprints.

A record is JSON.  Its nested field paths, without types, are hashed; the hash selects a declarative mapping that says
where the turns are.  The canonical turns (role, text) are written by one template and can be read back from it.

Template: every turn is `<|role|>text</s>`, the role percent-encoded.  What could be taken for a mark inside a text
(`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`) gets a backslash after its bracket; such a string that has backslashes there
already gets one more, so that taking one away restores every text.

Null roles and texts are empty.  A record whose fingerprint no mapping has, or that isn't valid JSON, keeps null turns and
layout; in a conversation gathered from several records it is counted, and the turns of the others stay.  Texts of
any length are mapped: what is fingerprinted is the record without its values.  An empty table has no rows.  Columns of the
caller pass, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pack

TURNS = "array<struct<role:string,text:string>>"
#: Spark's type names of scalars, which a fingerprint leaves out.
SCALAR = r"\b(STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DECIMAL\(\d+,\s*\d+\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY)\b"
#: No string is too long for the JSON reader.
JSON = {"maxStringLen": str(2**31 - 1)}
#: Stands for an escaped quote or backslash in a record without values.
ESCAPED = "\N{SYMBOL FOR ESCAPE}"
MARK = r"(/?s>|\|)"
INST = r"(/?INST\])"


@dataclass(frozen=True)
class Layout:
    """paths: top-level fields and their kind ("": a scalar); optional ones may be missing; turns: how to get them."""

    name: str
    fields: dict
    optional: tuple[str, ...]
    schema: str
    role: str = "role"
    text: str = "text"
    at: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def __hash__(self) -> int:
        return hash(self.name)

    def fingerprints(self) -> list[str]:
        out = []
        for n in range(len(self.optional) + 1):
            for gone in combinations(self.optional, n):
                out.append(fingerprint_of({k: v for k, v in self.fields.items() if k not in gone}))
        return out

    def turns(self, record: Column) -> Column:
        row = F.from_json(record, self.schema, JSON)
        if self.fixed:
            made = [
                F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(F.when(row[c] != "", row[c]) for c in cols)).alias("text"))
                for role, cols in self.fixed
            ]
            return F.array(*made).cast(TURNS)
        items = row[self.at] if self.at else F.array(row)
        names = F.create_map(*(F.lit(x) for pair in self.roles for x in pair)) if self.roles else None

        def one(x):
            role = F.coalesce(x[self.role], F.lit(""))
            role = F.coalesce(F.try_element_at(names, role), role) if names is not None else role
            return F.struct(role.alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

        return F.transform(items, one).cast(TURNS)


def _shape(fields: dict) -> str:
    parts = (k + ": " + ("" if v == "" else f"ARRAY<OBJECT<{', '.join(f'{n}: ' for n in sorted(v))}>>") for k, v in sorted(fields.items()))
    return f"OBJECT<{', '.join(parts)}>"


def fingerprint_of(fields: dict) -> str:
    return hashlib.sha256(_shape(fields).encode()).hexdigest()


LAYOUTS = (
    Layout("turn_row", {"conv_id": "", "turn": "", "role": "", "text": ""}, ("conv_id", "turn", "role", "text"), "role string, text string"),
    Layout("messages", {"id": "", "messages": ("role", "content")}, ("id",), "messages array<struct<role:string,content:string>>", text="content", at="messages"),
    Layout(
        "dialogue", {"id": "", "conversations": ("from", "value")}, ("id",), "conversations array<struct<`from`:string,value:string>>",
        role="from", text="value", at="conversations", roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout(
        "instruction", {"id": "", "instruction": "", "input": "", "output": ""}, ("id", "input"),
        "instruction string, input string, output string", fixed=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout("prompt", {"id": "", "prompt": "", "completion": ""}, ("id",), "prompt string, completion string", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", {"id": "", "question": "", "answer": ""}, ("id",), "question string, answer string", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def bare(record: Column) -> Column:
    """A JSON text with empty strings for its string values.

    Equal neighbours in an array of flat objects count once.  So the length depends on the fields, not on texts or turns.
    """
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit(ESCAPED)), F.lit('\\"'), F.lit(ESCAPED))
    short = F.regexp_replace(plain, r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')
    parts = F.split(short, r"(?<=\})\s*+,\s*+(?=\{)")
    flat = lambda p: p.rlike(r"^\{[^{}\[\]]*+\}$")
    before = F.concat(F.array(F.lit("")), parts)
    once = F.array_compact(F.zip_with(parts, before, lambda p, q: F.when((p != q) | ~flat(p), p)))
    return F.array_join(once, ",")


def fingerprint(record: Column) -> Column:
    """The hash of a JSON text's nested field paths; null if it isn't JSON."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(F.try_parse_json(bare(record))), SCALAR, ""), 256)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of records, all by default), `layout` and `turns` (role, text), both null where no mapping has the record's fingerprint."""
    rows = pack(records, carry, own=record).withColumn("print", fingerprint(F.col("own")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        fits = F.col("print").isin(x.fingerprints())
        layout, turns = F.when(fits, x.name).otherwise(layout), F.when(fits, x.turns(F.col("own"))).otherwise(turns)
    return rows.select("doc", layout.alias("layout"), turns.alias("turns")).withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def escape(text: Column) -> Column:
    once = F.regexp_replace(text, r"<(\\*)" + MARK, r"<\\$1$2")
    return F.regexp_replace(once, r"\[(\\*)" + INST, r"[\\$1$2")


def unescape(text: Column) -> Column:
    once = F.regexp_replace(text, r"<\\(\\*)" + MARK, r"<$1$2")
    return F.regexp_replace(once, r"\[\\(\\*)" + INST, r"[$1$2")


def render(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns with `formatted` and `loss`: spans of code points (end exclusive) of the trained roles' texts."""
    marked = turns.drop("formatted", "loss").withColumn(
        "_parts",
        F.transform("turns", lambda t: F.struct(
            F.concat(F.lit("<|"), F.url_encode(F.coalesce(t["role"], F.lit(""))), F.lit("|>")).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"), t["role"].isin(*trained).alias("on"),
        )),
    )
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "")
    spans = F.aggregate(
        "_parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + 4).alias("at"),
            F.when(p["on"], F.array_append(s["spans"], F.struct(
                (s["at"] + F.length(p["head"])).alias("start"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))
            .otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return marked.withColumns({"formatted": text, "loss": spans}).drop("_parts")


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")

    def one(p):
        at = F.locate("|>", p)
        return F.struct(F.url_decode(p.substr(F.lit(3), at - 3)).alias("role"), unescape(p.substr(at + 2, F.length(p))).alias("text"))

    return F.transform(parts, one)


def under_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(formatted.substr(s["start"] + 1, s["end"] - s["start"])))


def gather(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conversation, turns and unmapped, from the records of single turns that canonical() gives.

    Turns are in order of turn, then of the turns themselves.  Records without a mapping add none and are counted.  A conversation's
    turns are one row, as its formatted text is.
    """
    each = F.struct(F.col("doc")[turn].alias("at"), "turns")
    grouped = rows.groupBy(F.col("doc")[conv].alias("conversation")).agg(F.sort_array(F.collect_list(each)).alias("all"), F.sum(F.col("turns").isNull().cast("long")).alias("unmapped"))
    own = F.transform("all", lambda x: F.coalesce(x["turns"], F.array().cast(TURNS)))
    return grouped.select("conversation", F.flatten(own).alias("turns"), "unmapped")
