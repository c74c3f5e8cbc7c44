"""Programs as links: base64url of a small JSON object."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.schema import CHANNELS, PROGRAM_PIXELS, SHARE_CHARS, SHARE_CODE_CHARS

PREFIX = "#glsl="


def check(state) -> dict:
    ok = isinstance(state, dict) and state.get("v") == 1 and isinstance(state.get("c"), str)
    size = [state.get(k) for k in "wh"] if ok else []
    if not ok or not all(isinstance(n, int) and not isinstance(n, bool) and n >= 1 for n in size) or size[0] * size[1] > PROGRAM_PIXELS:
        raise ValueError("These are not the settings of a program.")
    if len(state["c"]) > SHARE_CODE_CHARS:
        raise ValueError("The program is too long for a link.")
    return {"width": size[0], "height": size[1], "code": state["c"]}


def encode(width: int, height: int, code: str) -> str:
    check({"v": 1, "w": width, "h": height, "c": code})
    text = json.dumps({"v": 1, "w": width, "h": height, "c": code}, separators=(",", ":"), ensure_ascii=False)
    packed = base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    if len(packed) > SHARE_CHARS:
        raise ValueError("The link gets too long.")
    return PREFIX + packed


def decode(link: str) -> dict | None:
    if not link.startswith(PREFIX):
        return None
    packed = link.removeprefix(PREFIX)
    try:
        if len(packed) > SHARE_CHARS:
            raise ValueError("link is too long")
        text = base64.b64decode(packed + "=" * (-len(packed) % 4), altchars=b"-_", validate=True).decode("utf-8")
        return check(json.loads(text))
    except ValueError as e:
        raise ValueError(f"The link can't be read: {e}") from e


def code_of(channels: dict[str, str]) -> str:
    """The text of a program of column expressions, a line for each channel."""
    return "\n".join(f"{c} = {e}" for c, e in channels.items())


def channels_of_code(code: str) -> dict[str, str]:
    """The expressions of a text of such lines; other texts raise."""
    out = {}
    for n, line in enumerate(code.splitlines(), 1):
        name, sign, expression = line.partition("=")
        if not line.strip():
            continue
        if not sign or name.strip() not in CHANNELS or name.strip() in out or not expression.strip():
            raise ValueError(f"Line {n} is no `channel = expression`.")
        out[name.strip()] = expression.strip()
    return out


def base64url(c: Column) -> Column:
    """Text as base64url without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    return F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")
