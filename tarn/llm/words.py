"""Words of notebooks and other texts, whatever the layout they were written out in."""

from __future__ import annotations

import json
import re
import unicodedata

from tarn.llm.lookalike import INVISIBLE, MATHEMATICAL, TRANSLATION

_words = re.compile(r"[^\W_]+").findall
# Marks of the layouts: cell headings and prompts, code fences, terminal codes.
_marks = re.compile(r"^# %%(?: \[\w+\])?[^\n]*$|^(?:In|Out) ?\[[ \d]*\]:|^```\w*[ \t]*$|\x1b\[[0-9;]*[A-Za-z]", re.M)
_escapes = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"\\/]))")
_skipped = {"cell_type", "output_type", "metadata", "name", "nbformat", "nbformat_minor", "execution_count", "id"}


# a class of the basic plane is looked up in a table; characters beyond it would be tried one by one, so the block is a range
_special = re.compile(f"[{INVISIBLE}{chr(MATHEMATICAL[0])}-{chr(MATHEMATICAL[1] - 1)}{re.escape(''.join(chr(c) for c in TRANSLATION if c < 0x10000))}]")


def _plain(m: re.Match) -> str:
    c = m[0]
    return TRANSLATION.get(ord(c), c if MATHEMATICAL[0] <= ord(c) < MATHEMATICAL[1] else "")


def folded(text: str) -> str:
    """Without invisible characters, look-alikes as their plain letters, composed, lower case."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text, n = _special.subn(_plain, text)
        if n and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return text.lower()


def _strings(x, out: list[str]) -> None:
    if isinstance(x, str):
        out.append(x)
    elif isinstance(x, list):
        if x and all(isinstance(y, str) for y in x):
            out.append("".join(x))
        else:
            for y in x:
                _strings(y, out)
    elif isinstance(x, dict):
        for k, y in x.items():
            if k not in _skipped:
                _strings(y, out)


def content(text: str) -> str:
    """What the cells of a notebook hold, without the layout's own marks. Text that is no notebook stays as it is."""
    if text.lstrip()[:1] == "{" and '"cells"' in text:
        try:
            out: list[str] = []
            _strings(json.loads(text, strict=False), out)
            return "\n".join(out)
        except (ValueError, RecursionError):
            return _escapes.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    return _marks.sub(" ", text) if "# %%" in text or "```" in text or "]:" in text or "\x1b" in text else text


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the content, folded."""
    if not text:
        return []
    if not text.isascii():  # look-alike brackets, quotes and letters would hide a layout's marks
        text = _special.sub(_plain, text)
    return _words(folded(content(text)))
