"""Folds along one series for rules whose anchor moves with what has been kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

HEARTBEAT = 12 * 3600
QUOTE = ["user_id", "event_id", "ts", "price", "volume"]


def kept_heartbeats(batches: Iterator[pd.DataFrame], heartbeat: int = HEARTBEAT) -> Iterator[pd.DataFrame]:
    """The quotes kept of ``(user_id, event_id, ts, price, volume, session_open, run)`` in order of user, run and time, batch by batch.

    A run is a stretch of a user's quotes of one price and volume. A quote of the last kept one's run takes its place in a closed session and is
    dropped within a heartbeat; all others are kept. The last kept quote is held back until the next one shows whether it stays, so it is all
    that passes from batch to batch, and runs don't depend on each other.
    """
    held = own = None
    for rows in batches:
        out = []
        for user, event, ts, price, volume, is_open, run in rows[[*QUOTE, "session_open", "run"]].itertuples(index=False, name=None):
            if held is not None and held[0] == user and own == run:
                if is_open:
                    if (ts - held[2]).total_seconds() < heartbeat:
                        continue
                    out.append(held)
            elif held is not None:
                out.append(held)
            held, own = (user, event, ts, price, volume), run
        yield pd.DataFrame(out, columns=QUOTE)
    if held is not None:
        yield pd.DataFrame([held], columns=QUOTE)
