"""Conversations as one text each, by a compiled template, with the spans that a model is to learn from.

Rows are sorted by conversation and turn inside a task and pass through it as a stream, so that a conversation of any length needs
the memory of some turns. A conversation is written in pieces of whole turns.

Texts must not be able to end their turn: a backslash is put behind the first character of each control string inside a text, and
a backslash of the text itself is doubled. So no control string is left in it, and reading back undoes both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .queries import Query
from .template import Template

#: How a turn of each role begins and ends; turns of other roles also name it.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
CONTROLS = (*(x for pair in TURNS.values() for x in pair), *OTHER)

TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == "assistant" -%}
<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
{%- elif m.role == "user" -%}
[INST]{{ m.text | escape }}[/INST]
{%- elif m.role == "system" -%}
<<SYS>>{{ m.text | escape }}<</SYS>>
{%- else -%}
<<ROLE>>{{ m.role | escape }}<<TEXT>>{{ m.text | escape }}<</ROLE>>
{%- endif -%}
{%- endfor -%}
"""

#: Characters of text in a row of the output, about.
PIECE_CHARS = 1 << 20

PIECES = "part int, start long, text string, spans array<struct<start: int, end: int>>"


class Escape:
    """Makes texts safe between control strings, and undoes it."""

    def __init__(self, controls: Iterable[str] = CONTROLS):
        controls = sorted(set(controls))
        for c in controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string has two characters or more and no backslash: {c!r}")
            for i in range(1, len(c)):
                for d in controls:
                    if d.startswith(c[i:]) or c[i:].startswith(d):
                        raise ValueError(f"the end of a text and {d!r} could look like {c!r}")
        self.controls = controls
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
        self._find, self._undo = re.compile(rf"\\|{heads}"), re.compile(r"\\(\\?)")
        self.cut = re.compile("|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True)))

    def __call__(self, text: str) -> str:
        return self._find.sub(lambda m: m[0] + "\\", text)

    def undo(self, text: str) -> str:
        return self._undo.sub(r"\1", text) if "\\" in text else text


def read_turns(text: str, escape: Escape) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    roles = {begin: (role, end) for role, (begin, end) in TURNS.items()}
    at = 0

    def upto(end: str) -> str:
        nonlocal at
        m = escape.cut.search(text, at)
        if not m or m[0] != end:
            raise ValueError(f"{end!r} is missing after character {at}")
        inner, at = text[at: m.start()], m.end()
        return escape.undo(inner)

    while at < len(text):
        m = escape.cut.match(text, at)
        if not m or (m[0] not in roles and m[0] != OTHER[0]):
            raise ValueError(f"no turn begins at character {at}")
        at = m.end()
        if m[0] in roles:
            role, end = roles[m[0]]
        else:
            role, end = upto(OTHER[1]), OTHER[2]
        yield role, upto(end)


def format_conversations(rows: DataFrame, template: str = TEMPLATE, controls: Iterable[str] = CONTROLS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, part, start, text, spans): the formatted text of each conversation of ``rows`` (conv_id, turn, role, text).

    The pieces of a conversation follow each other in one partition, part 0 first; each holds whole turns, ``start`` is its first
    character in the whole text, and ``spans`` are the generated characters of the piece. Turns go by ``turn``, null first, and
    equal ones by role and text; rows that repeat are turns of their own. Null roles and texts are empty. All rows without conv_id are
    one conversation. Other columns are not read. An empty table gives no rows.

    Turns are streamed, unless the template looks at ``messages`` outside its one loop; then a conversation is held as a whole.
    """
    escape = Escape(controls)
    Template(template, {"escape": escape})  # mistakes show here, not in a task
    plain = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = plain.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    kind = plain.schema["conv_id"].dataType.simpleString()

    def work(batches):
        compiled = Template(template, {"escape": escape})
        schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("text", pa.string()),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        ready: list[tuple] = []  # pieces that wait for a batch of their own
        ids: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*ready), schema)]
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], ["conv_id", *schema.names])
            ready.clear()
            ids.clear()
            return batch

        held = 0
        for conv, messages in conversations(batches):
            start = 0
            for part, (text, spans) in enumerate(compiled.pieces(messages, piece_chars)):
                ready.append((part, start, text, [{"start": a, "end": b} for a, b in spans]))
                ids.append(conv)
                start += len(text)
                held += len(text) + 100
                if held >= piece_chars:
                    yield flush()
                    held = 0
        if ready:
            yield flush()

    return sorted_rows.mapInArrow(work, f"conv_id {kind}, {PIECES}")


def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Iterator[dict]]]:
    """Each conversation of sorted rows: its id, as an array of one, and its messages. One must be used up before the next."""

    def rows() -> Iterator[tuple[object, pa.Array, dict]]:
        for batch in batches:
            ids = batch.column("conv_id")
            names, role, text = ids.to_pylist(), batch.column("role"), batch.column("text")
            for i, name in enumerate(names):
                yield name, ids.slice(i, 1), {"role": role[i].as_py(), "text": text[i].as_py()}

    stream = rows()
    now = next(stream, None)

    def same(name: object) -> Iterator[dict]:
        nonlocal now
        while now is not None and now[0] == name:
            message = now[2]
            now = next(stream, None)
            yield message

    while now is not None:
        messages = same(now[0])
        yield now[1], messages
        for _ in messages:  # what the template did not look at
            pass


def read_back(formatted: DataFrame, controls: Iterable[str] = CONTROLS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its formatted pieces.

    Pieces must follow each other as ``format_conversations`` gives them. Turns are hashed one after the other as role, line break,
    text, line break; the text under the generation spans is hashed and counted with nothing between the spans. An empty table gives no
    rows.
    """
    escape = Escape(controls)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches):
        done: list[tuple] = []
        ids: list[pa.Array] = []
        now = None

        def close() -> None:
            conv, n, turns, chars, loss, size = now
            ids.append(conv)
            done.append((n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(zip(*done), kinds))], names)
            done.clear()
            ids.clear()
            return batch

        for batch in batches:
            conv = batch.column("conv_id")
            for i, (part, text, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "text", "spans")))):
                if part == 0:
                    if now is not None:
                        close()
                    now = [conv.slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text, escape):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = escape.undo(text[span["start"]: span["end"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
                if len(done) >= 5000:
                    yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    return formatted.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed value: what both turns of conversation -1 say.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))


_ANY = "|".join(re.escape(c) for c in CONTROLS)


def _escaped_sql(c: str) -> str:
    return rf"(len({c}) + len({c}) - len(replace({c}, '\', '')) + len(regexp_extract_all({c}, '{_ANY}')))"


OP11_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) turns_sha256,
       cast(coalesce(sum(len(t)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (where role = 'assistant'), '')) loss_sha256,
       cast(sum({_escaped_sql('t')} + case role {' '.join(f"when '{r}' then {len(a + b)}" for r, (a, b) in TURNS.items())}
           else {len(''.join(OTHER))} + {_escaped_sql('role')} end) as bigint) formatted_chars
from c group by conv_id
"""

QUERIES = {"op11_chat": Query(op11_chat, OP11_SQL)}
