"""Cutting a text where byte-level BPE never joins anything, so that repeated pieces are encoded once.

The pre-tokenization pattern lets a token span white space only as a run or as one leading space. Before a
space that follows a non-space there is therefore always a token boundary, and what follows does not look
back. Texts with white space other than space, tab and line ends are not cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketry.llm.common import ragged_take

_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")
_HARD = re.compile(r"  |\n \n|[\t\r]")
_CUT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: The same conditions, as Arrow's regular expressions have them; NUL marks the cuts there.
_NOT_BY_SPACES = r"   | \n|[\t\r\x00]|\n $|[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A piece that is a word or a number, and ASCII signs after it: two tokens of the pattern, or one.
_PLAIN = r"^(?P<head> ?(?:[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+|[0-9]+))(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


def pieces(text: str) -> list[str]:
    """Parts of text, in order, whose encodings concatenate to the encoding of text."""
    if not text:
        return []
    if _OTHER_SPACE.search(text):
        return [text]
    if _HARD.search(text) or text.endswith("\n "):
        return _CUT.findall(text)
    first, *rest = text.split(" ")
    out = [" " + p for p in rest]
    return [first, *out] if first else out


def cut_column(texts: pa.Array, whole: re.Pattern | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, the places in it of each text's pieces one text after the other, their number by text).

    A text in which `whole` is found is one piece. Most texts are cut and their pieces told apart by Arrow; Python sees the others only.
    """
    texts = pc.fill_null(texts, "")
    hard = pc.match_substring_regex(texts, _NOT_BY_SPACES)
    if whole is not None:
        hard = pc.or_(hard, pc.match_substring_regex(texts, whole.pattern))
    hard = hard.to_numpy(zero_copy_only=False)
    marked = pc.replace_substring(texts.filter(pa.array(~hard)), " ", "\x00 ")
    # a single line end between two signs that are no white space is a token by itself
    marked = pc.if_else(pc.match_substring_regex(marked, r"\n[\n\x00]"), marked, pc.replace_substring(marked, "\n", "\x00\n\x00"))
    easy = pc.split_pattern(marked, "\x00")
    coded = pc.list_flatten(easy).dictionary_encode()
    at, lengths = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(len(texts), dtype=np.int64)
    lengths[~hard] = pc.list_value_length(easy).to_numpy(zero_copy_only=False)
    if not hard.any():
        return coded.dictionary, at, lengths
    seen: dict[str, int] = {}
    cuts = [[t] if whole is not None and whole.search(t) else pieces(t) for t in texts.filter(pa.array(hard)).to_pylist()]
    own = np.fromiter((seen.setdefault(p, len(seen)) for c in cuts for p in c), dtype=np.int64)
    lengths[hard] = list(map(len, cuts))
    starts = np.zeros(len(texts), dtype=np.int64)
    for mask, base in ((~hard, 0), (hard, len(at))):
        starts[mask] = base + np.cumsum(lengths[mask]) - lengths[mask]
    both = np.concatenate([at, own + len(coded.dictionary)])
    return pa.concat_arrays([coded.dictionary, pa.array(list(seen), pa.string())]), ragged_take(both, starts, lengths), lengths


def heads_and_tails(distinct: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct parts, which of them are single tokens of the pattern, each piece's head among them, its tail or -1).

    A plain word or number and the signs after it are two parts, anything else is one."""
    found = pc.extract_regex(distinct, _PLAIN)
    plain = found.is_valid()
    heads = pc.if_else(plain, pc.struct_field(found, "head"), distinct)
    tails = pc.if_else(plain, pc.struct_field(found, "tail"), "")
    coded = pa.concat_arrays([heads, tails]).dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    single = np.zeros(len(coded.dictionary), dtype=bool)
    flags = plain.to_numpy(zero_copy_only=False)
    single[at[: len(distinct)][flags]] = True
    single[at[len(distinct) :][flags]] = True
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), single, at[: len(distinct)], at[len(distinct) :]
