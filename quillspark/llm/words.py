"""ASCII-folded words of texts: what decontamination and lexical search count."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa

#: Letters, digits and every byte of a sign beyond ASCII stay, A-Z as a-z; all else parts words.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in order; null has none."""
    return text.translate(FOLD).split() if text else []


def texts(column: pa.Array) -> Iterable[bytes | None]:
    """A string column's values as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())
