"""Alphabets and the Column expressions they define."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Auto:
    def __repr__(self) -> str:
        return "AUTO"


#: Stands for "derive it from the characters".
AUTO = _Auto()
#: The default alphabet, its complement pairs and its unknown character.
DNA = "atgc"
DNA_PAIRS = {"a": "t", "t": "a", "g": "c", "c": "g"}
UNKNOWN = "n"
#: Digits of positional systems up to base 36.
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True, eq=False)
class Alphabet:
    """An ordered set of single characters, optionally with a complement and an unknown placeholder.

    The order gives characters their codes. Without ``case_sensitive`` everything is lower-cased. ``complement``
    is AUTO, None, a mapping, or a string with the partner of each given character.
    """

    characters: tuple[str, ...]
    case_sensitive: bool
    pairs: Mapping[str, str] | None
    unknown: str | None

    def __init__(self, characters: Iterable[str] = DNA, *, case_sensitive: bool = False, complement=AUTO, unknown=AUTO) -> None:
        given = list(characters)
        if not given:
            raise ValueError("an alphabet needs characters")
        if any(not isinstance(c, str) or len(c) != 1 for c in given):
            raise ValueError("every entry of an alphabet is one character")
        given = [self._cased(c, case_sensitive) for c in given]
        chars = tuple(dict.fromkeys(given))
        put = object.__setattr__
        put(self, "characters", chars)
        put(self, "case_sensitive", case_sensitive)
        if unknown is AUTO:
            unknown = None if UNKNOWN in chars else UNKNOWN
        elif unknown:
            if len(unknown) != 1:
                raise ValueError("the unknown placeholder is one character")
            unknown = self._cased(unknown, case_sensitive)
            if unknown in chars:
                raise ValueError("the unknown placeholder must not be in the alphabet")
        put(self, "unknown", unknown or None)
        put(self, "pairs", self._pairing(given, chars, complement))

    @staticmethod
    def _cased(c: str, case_sensitive: bool) -> str:
        if case_sensitive:
            return c
        low = c.lower()
        if len(low) != 1:
            raise ValueError(f"{c!r} changes its length when lower-cased")
        return low

    def _pairing(self, given: list[str], chars: tuple[str, ...], complement) -> Mapping[str, str] | None:
        if complement is AUTO:
            return dict(DNA_PAIRS) if set(chars) == set(DNA) else None
        if not complement:
            return None
        if isinstance(complement, str):
            if len(complement) != len(given):
                raise ValueError("a complement string has one character for each of the alphabet")
            listed = list(zip(given, complement, strict=True))
        else:
            listed = list(complement.items())
        pairs: dict[str, str] = {}
        for a, b in listed:
            if len(a) != 1 or len(b) != 1:
                raise ValueError("a complement pairs single characters")
            a, b = self._cased(a, self.case_sensitive), self._cased(b, self.case_sensitive)
            for x, y in ((a, b), (b, a)):
                if x not in chars and x != self.unknown:
                    raise ValueError(f"complement of {x!r}, which is not in the alphabet")
                if pairs.setdefault(x, y) != y:
                    raise ValueError(f"{x!r} has two complements")
        return {c: pairs.get(c, c) for c in chars} | {c: d for c, d in pairs.items() if c == self.unknown and d != c}

    def _key(self):
        return self.characters, self.case_sensitive, tuple(sorted((self.pairs or {}).items())), self.unknown

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Alphabet) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def __len__(self) -> int:
        return len(self.characters)

    # --- driver side

    @property
    def base(self) -> int:
        return len(self.characters)

    def symbols(self, include_unknown: bool = False) -> str:
        if include_unknown and not self.unknown:
            raise ValueError("this alphabet has no unknown placeholder")
        return "".join(self.characters) + (self.unknown if include_unknown else "")

    def codes(self, include_unknown: bool = False) -> dict[str, int]:
        return {c: i for i, c in enumerate(self.symbols(include_unknown))}

    def complement_of(self, text: str) -> str:
        """Reverse complement of a driver-side string; identity without a complement."""
        return "".join(self.pairs.get(c, c) for c in reversed(text)) if self.pairs else text

    def canonical_of(self, text: str) -> str:
        return min(text, self.complement_of(text))

    def fits(self, text: str) -> bool:
        allowed = set(self.characters) | ({self.unknown} if self.unknown else set())
        return all(c in allowed for c in (text if self.case_sensitive else text.lower()))

    def to_dict(self) -> dict:
        return {"characters": "".join(self.characters), "case_sensitive": self.case_sensitive, "complement": dict(self.pairs) if self.pairs else None, "unknown": self.unknown}

    @classmethod
    def from_dict(cls, d: Mapping | None) -> Alphabet:
        return cls() if d is None else cls(d["characters"], case_sensitive=d["case_sensitive"], complement=d["complement"], unknown=d["unknown"])

    # --- Column expressions

    def _class(self, include_unknown: bool = False, negate: bool = True) -> str:
        body = "".join(f"\\x{{{ord(c):x}}}" for c in self.symbols(include_unknown and bool(self.unknown)))
        return f"[{'^' if negate else ''}{body}]"

    def normalise(self, text: Column | str) -> Column:
        return _col(text) if self.case_sensitive else F.lower(_col(text))

    def sanitise(self, text: Column | str, keep_unknown: bool = False) -> Column:
        """Deletes characters outside the alphabet, or puts the unknown placeholder for each."""
        if keep_unknown and not self.unknown:
            raise ValueError("this alphabet has no unknown placeholder")
        return F.regexp_replace(self.normalise(text), self._class(), self.unknown.replace("\\", "\\\\").replace("$", "\\$") if keep_unknown else "")

    def reverse_complement(self, text: Column | str) -> Column:
        if not self.pairs:
            return _col(text)
        swap = {a: b for a, b in self.pairs.items() if a != b}
        return F.reverse(F.translate(_col(text), "".join(swap), "".join(swap.values())))

    def canonical(self, text: Column | str) -> Column:
        """The smaller, in code-point order, of a segment and its reverse complement."""
        return F.least(_col(text), self.reverse_complement(text)) if self.pairs else _col(text)

    def is_canonical(self, text: Column | str) -> Column:
        return _col(text) <= self.reverse_complement(text)

    def matchable(self, segment: Column | str) -> Column:
        """Segments that can be found: not empty, of this alphabet and placeholder, canonical."""
        s = _col(segment)
        return (F.length(s) > 0) & ~s.rlike(self._class(include_unknown=True)) & self.is_canonical(s)

    def encode(self, segment: Column | str) -> Column:
        """The segment as a number to the base of the alphabet, first character most significant; null if it does not fit."""
        s = _col(segment)
        if self.base <= len(_DIGITS) and not set(self.symbols()) & {"\0"}:  # the numbers of a positional system, in generated code
            number = F.conv(F.translate(s, self.symbols(), _DIGITS[: self.base]), max(self.base, 2), 10).cast("long")
            return F.when(F.length(s) == 0, F.lit(0).cast("long")).when(~s.rlike(self._class()), number)
        places = F.sequence(F.lit(1), F.length(s))
        code = lambda i: F.instr(F.lit(self.symbols()), F.substring(s, i, F.lit(1))) - 1
        value = F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a * self.base + code(i))
        return F.when(F.length(s) == 0, F.lit(0).cast("long")).when(~s.rlike(self._class()), value)

    def decode(self, number: Column | str, k: int) -> Column:
        """The segment of ``k`` characters with this number."""
        if k == 0:
            return F.lit("")
        powers = [self.base**e for e in range(k - 1, -1, -1)]
        if powers[0] * self.base > 2**63 - 1:
            raise ValueError("numbers of so long a segment do not fit")
        v = _col(number).cast("long")
        digit = lambda p: F.pmod(F.call_function("div", v, F.lit(p)), F.lit(self.base))
        return F.concat(*(F.substring(F.lit(self.symbols()), (digit(p) + 1).cast("int"), F.lit(1)) for p in powers))

