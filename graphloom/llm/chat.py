"""Chat formatting with DataFrame functions only: schema fingerprints choose a declarative mapping to canonical turns.

A record is a JSON text in any known layout. Its fingerprint is a hash of its sorted field paths, nested to any depth and
of all elements of its lists together; a table of mappings, keyed by the fingerprints of the layouts they
describe, says which fields become which turns, so a field that a mapping would not carry makes the layout an unknown one. Turns are then rendered by a template whose control strings are escaped
inside texts by one backslash after their first character, which unescape() takes out again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that chat templates and tokenizers give a meaning; inside a text each is escaped.
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]{1,32}\|>)"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]{1,32}\|>)"


@dataclass(frozen=True)
class Mapping:
    """keys: the record's top-level keys. Fixed turns as (role, fields...) in order, fields that aren't empty joined by an empty line; or a list field with the names of its role and text fields, and other names of roles."""

    name: str
    keys: tuple[str, ...]
    fixed: tuple[tuple[str, ...], ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    aliases: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> str:
        inner = {self.messages: f": ARRAY<OBJECT<{', '.join(sorted((self.role, self.text)))}>>"}
        return f"OBJECT<{', '.join(k + inner.get(k, '') for k in sorted(self.keys))}>"


#: Names of the roles in the from/value layout.
ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Further layouts are added as rows of this table.
MAPPINGS = (
    Mapping("messages", ("messages",), messages="messages"),
    Mapping("conversations", ("conversations",), messages="conversations", role="from", text="value", aliases=ALIASES),
    Mapping("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), (("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)
#: A field's plain type in the tree of paths; one of mixed types stays and is unknown.
PLAIN = r": (?:STRING|BIGINT|BOOLEAN|VOID|DOUBLE|DECIMAL\([0-9,]+\))(?=[,>])"


def field_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON record as one tree, such as OBJECT<messages: ARRAY<OBJECT<content, role>>>; null where the text is no JSON, names a field twice or takes over 128 MB."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), PLAIN, "")


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths; null where there are none to tell."""
    paths = field_paths(record)
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def known_fingerprint(mapping: Mapping) -> Column:
    return F.xxhash64(F.lit(mapping.paths))


def canonical_turns(record: Column, mark: Column) -> tuple[Column, Column]:
    """(mapping name, turns) by the fingerprint; both null for an unknown layout. Fields that are null or absent give empty texts."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if m.messages:
            parsed = F.from_json(record, f"`{m.messages}` array<struct<`{m.role}`:string,`{m.text}`:string>>")[m.messages]
            made = F.transform(parsed, _turn(m))
        else:
            parsed = F.from_json(record, ", ".join(f"`{k}` string" for k in m.keys))
            made = F.array(*(F.struct(F.lit(r).alias("role"), _joined(parsed, fields).alias("text")) for r, *fields in m.fixed))
        name = F.when(mark == known_fingerprint(m), F.lit(m.name)).otherwise(name)
        turns = F.when(mark == known_fingerprint(m), made).otherwise(turns)
    return name, turns


def _turn(m: Mapping):
    return lambda x: F.struct(_role(x[m.role], m.aliases).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))


def _joined(parsed: Column, fields: list[str]) -> Column:
    values = [F.coalesce(parsed[f], F.lit("")) for f in fields]
    return values[0] if len(values) == 1 else F.array_join(F.filter(F.array(*values), lambda x: x != ""), "\n\n")


def _role(role: Column, aliases: tuple[tuple[str, str], ...]) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in aliases:
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _line(role: Column) -> Column:
    """A role as one header line: backslashes and line ends are escaped, then control strings."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unline(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\0"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\"))


def render(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_runs` (array<struct<length, loss>>: run lengths in characters that cover formatted; loss is true for each text of the trained role)."""
    head = lambda t: F.concat(F.lit(OPEN), _line(t["role"]), F.lit("\n"))
    parts = F.transform(F.col(turns), lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss")))
    own = "parts"
    while own in df.columns:
        own += "_"
    df = df.withColumn(own, parts)
    run = lambda n, on: F.struct(n.cast("long").alias("length"), on.alias("loss"))
    runs = F.flatten(F.transform(own, lambda p: F.array(run(F.length(p["head"]), F.lit(False)), run(F.length(p["body"]), p["loss"]), run(F.lit(len(CLOSE) + 1), F.lit(False)))))
    text = F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    return df.withColumns({"formatted": text, "loss_runs": runs}).drop(own)


def read_back(formatted: Column, loss_runs: Column) -> tuple[Column, Column]:
    """From the rendered text and its mask alone: (turns, texts under the mask), unescaped. Linear in the text's length."""
    parts = F.split(F.substring(formatted, len(OPEN) + 1, 2**31 - 1), _literal(CLOSE) + "\n" + _literal(OPEN), -1)
    parts = F.transform(parts, lambda p, i: F.when(i == F.size(parts) - 1, F.regexp_replace(p, _literal(CLOSE) + r"\n\z", "")).otherwise(p))
    at = lambda p: F.locate("\n", p)
    turns = F.transform(parts, lambda p: F.struct(_unline(F.left(p, at(p) - 1)).alias("role"), unescape(F.substr(p, at(p) + 1)).alias("text")))
    under = F.transform(parts, lambda p, i: F.struct(loss_runs[3 * i + 1]["loss"].alias("loss"), unescape(F.substr(p, (loss_runs[3 * i]["length"] - len(OPEN) + 1).cast("int"), loss_runs[3 * i + 1]["length"].cast("int"))).alias("text")))
    return F.when(formatted == "", F.array().cast(TURNS)).otherwise(turns), F.when(formatted == "", F.array().cast("array<string>")).otherwise(F.transform(F.filter(under, lambda u: u["loss"]), lambda u: u["text"]))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "|<>[]" else c for c in text)


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint, mapping, turns, formatted and loss_runs to a table with a JSON text column.

    A null, malformed or unknown record has a null mapping and null turns, its text stays in the record (nothing is
    dropped); an empty list of messages and messages of several layouts have unknown fingerprints. Other columns are
    kept; those of the names above are replaced.
    """
    need(records, record)
    df = records.withColumn("fingerprint", fingerprint(F.col(record)))
    name, turns = canonical_turns(F.col(record), F.col("fingerprint"))
    return render(df.withColumns({"mapping": name, "turns": turns}))


def records_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, record): one JSON record each, in the plainest layout that holds it.

    Turns are ordered by turn, then role and text; a null text or role is empty. A user turn and its answer become a
    prompt record (of three layouts, by a hash of the id), all others a list of messages (of two layouts).
    """
    need(conversations, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    t = F.col("t")
    single = (F.size(t) == 2) & (t[0]["role"] == "user") & (t[1]["role"] == "assistant")
    plain = ~F.exists(t, lambda x: x["role"].isin(*(old for old, _ in ALIASES)))
    text = lambda i: t[i]["text"]
    record = (
        F.when(single & (kind == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(single & (kind == 1), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(single & (kind == 2), F.to_json(F.struct(text(0).alias("question"), text(1).alias("answer"))))
        .when(~plain | (kind < 5), F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))))
    )
    return own.select("conv_id", record.alias("record"))


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the rendered text and its mask say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns, under = read_back(F.col("formatted"), F.col("loss_runs"))
    df = formatted.select(key, "formatted", turns.alias("t"), F.array_join(under, "").alias("u"))
    flat = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        key,
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("u").cast("long").alias("loss_chars"),
        F.sha2(F.col("u").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
