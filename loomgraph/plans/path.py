"""Placement paths: ``/eu-de/zone:*/#42``."""

from __future__ import annotations

from dataclasses import dataclass, field

SPECIAL = "/:#*\\"


@dataclass(frozen=True)
class Segment:
    """One step: by id, or by name and type, each of which may be open."""

    name: str | None = None
    type: str | None = None
    id: int | None = None

    @property
    def any(self) -> bool:
        return self.id is None and self.name is None

    def __str__(self) -> str:
        if self.id is not None:
            return f"#{self.id}"
        quoted = lambda s: "".join("\\" + c if c in SPECIAL else c for c in s)
        name = "*" if self.name is None else quoted(self.name)
        return name if self.type is None else f"{quoted(self.type)}:{name}"


@dataclass(frozen=True)
class Path:
    segments: tuple[Segment, ...] = field(default=())

    @staticmethod
    def parse(text: str) -> Path:
        if not text.startswith("/"):
            raise ValueError(f"a path begins with '/': {text!r}")
        if text == "/":
            return Path()
        return Path(tuple(_segment(part, text) for part in _split(text[1:], "/", text)))

    def child(self, name: str, type: str | None = None) -> Path:
        return Path((*self.segments, Segment(name, type)))

    def __len__(self) -> int:
        return len(self.segments)

    def __str__(self) -> str:
        return "/" + "/".join(map(str, self.segments))


def _split(text: str, mark: str, whole: str) -> list[list[tuple[str, bool]]]:
    """Parts between unescaped marks, as characters with whether each was escaped."""
    parts: list[list[tuple[str, bool]]] = [[]]
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if i + 1 == len(text):
                raise ValueError(f"dangling escape in {whole!r}")
            parts[-1].append((text[i + 1], True))
            i += 2
            continue
        if c == mark:
            parts.append([])
        else:
            parts[-1].append((c, False))
        i += 1
    return parts


def _segment(part: list[tuple[str, bool]], whole: str) -> Segment:
    if not part:
        raise ValueError(f"empty segment in {whole!r}")
    if part[0] == ("#", False):
        digits = "".join(c for c, _ in part[1:])
        if not digits.removeprefix("-").isdigit():
            raise ValueError(f"an id is a number: {whole!r}")
        return Segment(id=int(digits))
    colon = next((i for i, c in enumerate(part) if c == (":", False)), None)
    kind = None if colon is None else "".join(c for c, _ in part[:colon])
    rest = part if colon is None else part[colon + 1 :]
    if not rest or kind == "":
        raise ValueError(f"empty segment in {whole!r}")
    if any(c == (":", False) for c in rest):
        raise ValueError(f"a segment has one type: {whole!r}")
    if rest == [("*", False)]:
        return Segment(type=kind)
    return Segment("".join(c for c, _ in rest), kind)
