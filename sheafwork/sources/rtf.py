"""Rich text: a tokenizer and a stack of group states."""

from __future__ import annotations

import re
from typing import Any

from .model import document
from .plain import plain as whole

_TOKEN = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
# Groups that hold no text; characters that control words stand for.
_SKIP = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"object", b"header", b"footer", b"generator", b"listtable", b"themedata"}
_WORDS = {b"par": "\n\n", b"sect": "\n\n", b"page": "\n\n", b"line": "\n", b"tab": "\t", b"emdash": "—", b"endash": "–", b"bullet": "•", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"cell": "\t", b"row": "\n"}


def text_of(data: bytes) -> str:
    out: list[str] = []
    state = {"skip": False, "uc": 1, "b": False, "i": False}
    stack: list[dict[str, Any]] = []
    drop = 0  # fallback characters that still follow a \u

    def put(text: str) -> None:
        nonlocal drop
        if drop:
            cut = min(drop, len(text))
            drop, text = drop - cut, text[cut:]
        if text and not state["skip"]:
            out.append(text)

    def toggle(key: str, on: bool) -> None:
        if state[key] != on:
            state[key] = on
            if not state["skip"]:
                out.append(f"\x00{key}{'+' if on else '-'}\x00")

    for m in _TOKEN.finditer(data):
        word, number, code, sign, brace, plain = m.groups()
        if brace == b"{":
            stack.append(dict(state))
        elif brace == b"}":
            before = stack.pop() if stack else dict(state)
            for key in ("b", "i"):
                toggle(key, before[key])
            state = before
        elif word:
            word = word.lower()
            if word in _SKIP:
                state["skip"] = True
            elif word in (b"b", b"i"):
                toggle(word.decode(), number != b"0")
            elif word == b"plain":
                toggle("b", False)
                toggle("i", False)
            elif word == b"uc":
                state["uc"] = int(number or 1)
            elif word == b"u" and number:
                put(chr(int(number) % 65536))
                drop = state["uc"]
            elif word in _WORDS:
                put(_WORDS[word])
        elif code:
            put(bytes.fromhex(code.decode()).decode("cp1252", "replace"))
        elif sign == b"*":
            state["skip"] = True
        elif sign:
            put({b"~": "\u00a0", b"_": "-", b"-": ""}.get(sign, sign.decode("latin-1") if sign in b"\\{}" else ""))
        elif plain:
            put(plain.decode("cp1252", "replace"))
    text = "".join(out)
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for key, mark in (("b", "**"), ("i", "_")):
        text = re.sub(f"\x00{key}\\+\x00(\\s*)(.*?)(\\s*)\x00{key}-\x00", lambda m: f"{m[1]}{mark}{m[2]}{mark}{m[3]}" if m[2] else m[1] + m[3], text, flags=re.S)
    return re.sub("\x00[bi][+-]\x00", "", text)


def parse_rtf(data: bytes, name: str, options: Any) -> dict[str, Any]:
    return document(whole(text_of(data)), warnings=["Rich text is converted approximately."])
