"""Email messages."""

from __future__ import annotations

import email
import email.policy
from typing import Any

from .html import blocks, tree
from .model import block, document
from .plain import clean, decode, plain as whole

# Headers that are kept.
HEADERS = ("From", "To", "Cc", "Subject", "Date", "Reply-To", "Message-ID")


def size(n: int) -> str:
    v, unit = float(n), 0
    while v >= 1024 and unit < 3:
        v, unit = v / 1024, unit + 1
    return f"{n} B" if not unit else f"{v:.1f} {('B', 'KB', 'MB', 'GB')[unit]}"


def parse_email(data: bytes, name: str, options: Any) -> dict[str, Any]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    facts = [(h, clean(str(message[h]))) for h in HEADERS if message[h]]
    out = [block("key_values", kv=facts)] if facts else []
    plain, html, attached = None, None, []
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            attached.append((part.get_filename() or "unnamed", len(part.get_payload(decode=True) or b"")))
            continue
        raw = part.get_payload(decode=True) or b""
        text = decode(raw, part.get_content_charset())
        if part.get_content_type() == "text/plain" and plain is None:
            plain = text
        elif part.get_content_type() == "text/html" and html is None:
            html = text
    if plain is not None and plain.strip():
        out += whole(plain)
    elif html is not None:
        out += blocks(tree(html))
    if attached:
        out += [block("heading", "Attachments", level=2), block("list", items=[(0, f"{n} ({size(b)})", None) for n, b in attached])]
    found = dict(facts)
    return document(out, found.get("Subject"), "metadata", {k.lower().replace("-", "_"): v for k, v in facts} | {"attachments": len(attached)}, [] if plain or html else ["The message has no text part."])
