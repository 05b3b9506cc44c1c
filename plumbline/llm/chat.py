"""Conversations as one training text with loss masks aligned to token offsets.

Template: each turn is ``### role:``, line feed, escaped text, line feed, ``</turn>``, line feed. Inside a text the backslash, ``#``
and the ``/`` of ``</`` are preceded by a backslash, so neither marker can appear there, and reading drops every backslash that stands before a character.
Where a text begins or ends with white space, or is empty, a guard (backslash, full stop) stands at that side: the tokenizer then never joins a text
with the marker beside it, and every token belongs to the text or to the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

TURN = "### "
END = "\n</turn>\n"
GUARD = "\\."
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_RENDERED = "formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    body = text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")
    if not body or body[0].isspace() or not body[0].isprintable():
        body = GUARD + body
    if body[-1].isspace() or not body[-1].isprintable():
        body += GUARD
    return body


def unescape(body: str) -> str:
    """Guards vanish; any other escaped character stands for itself."""
    return _ESCAPED.sub(lambda m: "" if m[1] == "." else m[1], body)


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("#", "\\#")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: Sequence[tuple[str, str]], learn: frozenset[str]) -> tuple[str, list[int], list[int]]:
    """The text of a whole conversation, and starts and ends of the (escaped) texts to learn from, ascending."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{TURN}{_escape_role(role)}:\n", escape(text)
        if role in learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation: the inverse of ``render``."""
    turns, at = [], 0
    while at < len(formatted):
        end = formatted.index("\n", at)  # a head is one line
        stop = formatted.index(END, end)
        turns.append((_unescape_role(formatted[at + len(TURN) : end - 1]), unescape(formatted[end + 1 : stop])))
        at = stop + len(END)
    return turns


def inside(starts: np.ndarray, ends: np.ndarray, token_starts: np.ndarray, token_ends: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the sorted, disjoint spans: the last span that begins before a token's end is found by binary search."""
    if not starts.size:
        return np.zeros(token_starts.size, dtype=bool)
    k = np.searchsorted(starts, token_ends, side="left") - 1
    return (k >= 0) & (token_starts < ends[np.maximum(k, 0)]) & (token_ends > token_starts)


def masked_text(formatted: str, token_starts: np.ndarray, token_ends: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The unescaped text under the mask, each character once (the bytes of one character may be several tokens)."""
    covered = np.zeros(len(formatted) + 1, dtype=np.int64)
    np.add.at(covered, token_starts[mask], 1)
    np.add.at(covered, token_ends[mask], -1)
    covered = np.cumsum(covered[:-1]) > 0
    chars = np.array(list(formatted), dtype=object)
    return "".join(unescape("".join(chars[s:e][covered[s:e]])) for s, e in zip(starts, ends, strict=True))


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def format_conversations(rows: DataFrame, tokenizer: str, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text; other columns ignored): formatted, input_ids, token_starts and
    token_ends (in characters), loss_mask (tokens of texts of the roles in ``learn``), loss_starts and loss_ends (spans of those texts).

    Turns are ordered by turn, then role, then text; equal rows are all kept. Null text and null role are empty, null turns
    come first, rows without conv_id form one conversation. The whole conversation is encoded once. An empty table gives no rows. A conversation is one row, so it must fit in
    a task, as a document must.
    """
    small_batches(rows.sparkSession, 128)
    learned = frozenset(learn)

    @F.pandas_udf(_RENDERED)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            rendered = [render([(x["role"], x["text"]) for x in turns], learned) for turns in batch]
            out = []
            for (text, starts, ends), e in zip(rendered, t.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                mask = inside(np.array(starts, dtype=np.int32), np.array(ends, dtype=np.int32), offsets[:, 0], offsets[:, 1])
                out.append((text, np.array(e.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1], mask, starts, ends))
            yield pd.DataFrame(out, columns=["formatted", "input_ids", "token_starts", "token_ends", "loss_mask", "loss_starts", "loss_ends"])

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    texts = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return whole.select("conv_id", make(texts).alias("r")).select("conv_id", "r.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: conv_id, turns (role, text), loss_text."""
    small_batches(formatted.sparkSession, 128)

    @F.pandas_udf("turns array<struct<role: string, text: string>>, loss_text string")
    def read(text: pd.Series, starts: pd.Series, ends: pd.Series, mask: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in text]
        loss = [masked_text(x, *map(np.asarray, (s, e, np.asarray(m, dtype=bool), p, q))) for x, s, e, m, p, q in zip(text, starts, ends, mask, a, b, strict=True)]
        return pd.DataFrame({"turns": turns, "loss_text": loss})

    return formatted.select("conv_id", "formatted", read("formatted", "token_starts", "token_ends", "loss_mask", "loss_starts", "loss_ends").alias("r")).select("conv_id", "formatted", "r.*")
