"""Arrow batches cut to what a scan can hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

PIECE = 1 << 19  # characters


def pieces(frames: Iterable[pd.DataFrame], text: str, most: int = PIECE) -> Iterator[pd.DataFrame]:
    """The rows of frames in pieces whose texts have ``most`` characters together, or of one row: what a scan makes of a text takes many times its size,
    and a frame holds as many texts as Spark's batches do."""
    for frame in frames:
        size = frame[text].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(int)
        start, held = 0, 0
        for n, k in enumerate(size.tolist()):
            if held and held + k > most:
                yield frame.iloc[start:n]
                start, held = n, 0
            held += k
        if start < len(frame):
            yield frame.iloc[start:]
