"""Chat formatting with typed content parts, and reading it back.

A message's content is a list of typed parts. A visitor has one method per type and turns
each part into text: text is escaped, and an image, a recording or a document becomes a
placeholder and an attachment with its reference and the number of tokens that the
placeholder stands for. Placeholders keep the order of the parts.

A turn is written as

    <s>[INST] role [/INST] content </s>

without the blanks. Control strings inside a role or a text are escaped: the escape character, then
the letter of the control string; the escape character itself becomes itself and 0. So no
control string of a formatted conversation comes from a text, and reading back is exact.

`format_turns` gives one row per turn; a conversation is its turns' texts in the order of
``turn_no``. One row per turn keeps a conversation of any length out of a single value.
Reading back goes through the turns in order and holds one turn at a time.

Defined results: a null role, text or part list is empty; turns are ordered by ``turn``, null first,
then role, then content, so repeated rows are turns of their own; a null ``conv_id`` is one
conversation; parts of an unknown type raise an error when the job runs; an empty table has no
conversations; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import nullable, whole_id

# Fixed values of the template.
TURN, ROLE, SAYS, END = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROL = [TURN, ROLE, SAYS, END, *PLACEHOLDERS.values()]
ESCAPE = "␛"
_LETTERS = {c: ESCAPE + chr(ord("A") + i) for i, c in enumerate(CONTROL)}

PART = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for control, code in _LETTERS.items():
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: str) -> str:
    back = {code[1]: control for control, code in _LETTERS.items()} | {"0": ESCAPE}
    return re.sub(ESCAPE + "(.)", lambda m: back[m[1]], text, flags=re.S)


class Visitor:
    """What a part becomes, by its type: (text, attachment tokens). Subclass to change a type."""

    #: Pixels of one image patch, patches merged into one token, tokens per second and per page.
    patch = 14
    merge = 2
    per_second = 25.0
    per_page = 512

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        side = self.patch * self.merge
        across = [F.ceil(F.coalesce(part[k], F.lit(0)) / side) for k in ("width", "height")]
        return F.lit(PLACEHOLDERS["image"]), (across[0] * across[1]).cast("long")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["audio"]), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.per_second).cast("long")

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["document"]), (F.coalesce(part["pages"], F.lit(0)) * self.per_page).cast("long")

    def visit(self, part: Column) -> Column:
        """struct<text, tokens> of one part."""
        kinds = ("text", "image", "audio", "document")
        unknown = F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(part["type"], F.lit("null"))))
        text, tokens = unknown.cast("string"), F.lit(None).cast("long")
        for kind in kinds:
            made = getattr(self, kind)(part)
            here = F.coalesce(part["type"], F.lit("text")) == kind
            text, tokens = F.when(here, made[0]).otherwise(text), F.when(here, made[1]).otherwise(tokens)
        return F.struct(text.alias("text"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """The part list of a plain text."""
    empty = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    kinds = {"ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
    return F.array(F.struct(*[v.alias(k) for k, v in empty.items()], *[F.lit(None).cast(t).alias(k) for k, t in kinds.items()]).cast(PART))


def format_turns(
    messages: DataFrame, loss_role: str = "assistant", visitor: Visitor | None = None,
    conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", parts_column: str = "parts",
) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_at, loss_chars, attachments.

    ``loss_at`` and ``loss_chars`` are the code points of ``formatted`` that bear loss: the
    content of a turn of ``loss_role``. ``attachments`` lists part number, type, reference,
    the place of the placeholder in ``formatted`` and its tokens.
    """
    visitor = visitor or Visitor()
    role = escaped(F.coalesce(F.col(role_column).cast("string"), F.lit("")))
    rows = messages.select(
        F.col(conv_column).cast("long").alias("conv_id"),
        F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.concat(F.lit(TURN + ROLE), role, F.lit(SAYS)).alias("head"),
        F.coalesce(F.col(parts_column).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
    ).withColumn("made", F.transform("parts", visitor.visit))
    content = F.array_join(F.transform("made", lambda m: m["text"]), "")
    # Where each part begins: the lengths of the head and of all parts before it.
    begins = F.transform(
        "parts",
        lambda p, k: F.aggregate(F.slice("made", F.lit(1), k), F.length("head").cast("long"), lambda a, m: a + F.length(m["text"])),
    )
    attached = F.filter(
        F.transform(
            F.arrays_zip("parts", "made", begins.alias("begins"), F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0))).alias("number")),
            lambda z: F.struct(
                z["number"].cast("long").alias("part"), z["parts"]["type"].alias("type"), z["parts"]["ref"].alias("ref"),
                z["begins"].alias("at"), z["made"]["tokens"].alias("tokens"),
            ),
        ),
        lambda a: a["tokens"].isNotNull(),
    )
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", content, F.lit(END)).alias("formatted"),
        F.when(F.col("role") == loss_role, F.length("head")).cast("long").alias("loss_at"),
        F.when(F.col("role") == loss_role, F.length(content)).otherwise(0).cast("long").alias("loss_chars"),
        attached.alias("attachments"),
    )


def in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in the order of the conversation."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "formatted")


_TURN = re.compile("".join(("(?s)", re.escape(TURN), re.escape(ROLE), "(.*?)", re.escape(SAYS), "(.*?)", re.escape(END))))


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted text alone and its loss spans.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns stream by
    in order; what is held is two running hashes, so the length of a conversation needs no
    memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One conversation: n_turns, all turns' hash, loss characters and hash, characters.
        now, state, out = None, None, []

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def frame() -> pd.DataFrame:
            made = pd.DataFrame([r[1:] for r in out], columns=names[1:])
            made.insert(0, "conv_id", nullable([r[0] or 0 for r in out], [r[0] is None for r in out]))
            return made

        for batch in batches:
            convs = [None if none else int(c) for c, none in zip(batch["conv_id"], batch["no_id"])]
            for conv, formatted, at, length in zip(convs, batch["formatted"], batch["loss_at"], batch["loss_chars"]):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                end = 0
                for found in _TURN.finditer(formatted):
                    if found.start() != end:
                        raise ValueError("text between turns")
                    role, text = map(unescape, found.groups())
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    end = found.end()
                if end != len(formatted):
                    raise ValueError("a turn is not closed")
                if not pd.isna(at):
                    loss = unescape(formatted[int(at) : int(at) + int(length)])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if len(out) > 5000:
                yield frame()
                out.clear()
        close()
        if out:
            yield frame()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    return in_order(turns).select(*whole_id("conv_id"), "formatted", "loss_at", "loss_chars").mapInPandas(run, schema)
