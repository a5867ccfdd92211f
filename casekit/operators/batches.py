"""Batches for encoders and predictors: as many texts as their tokens allow, fewer where
memory does not do."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

import numpy as np

#: Tokens of a batch, counting each text as long as the longest, and characters of a token.
TOKENS, CHARS = 16_384, 4


def out_of_memory(error: BaseException) -> bool:
    """Whether an error says that memory did not do, on the host or on a device."""
    return isinstance(error, MemoryError) or isinstance(error, RuntimeError) and "out of memory" in str(error).lower()


def in_batches(call: Callable[[list[str]], Sequence], texts: Sequence[str], most: int = 64, tokens: int = TOKENS, failed: Callable[[BaseException], bool] = out_of_memory) -> list:
    """``call`` of all ``texts``, a result for each, in their order.

    Texts of like length share a batch of at most ``most`` texts and about ``tokens`` tokens,
    padding included; a longer text is a batch of its own. A batch that fails for want of
    memory is halved until it passes, and no later batch is larger than what passed, in
    texts of that length or tokens in all; a single text that fails raises. Other errors
    raise at once, as does a ``call`` that gives too few or too many results.
    """
    sizes = [max(1, -(-len(t) // CHARS)) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -sizes[i])
    out: list = [None] * len(texts)
    at = 0
    while at < len(order):
        # The longest comes first, so it says how many fit.
        fit = max(1, min(most, tokens // sizes[order[at]]))
        some = order[at : at + fit]
        try:
            found = list(call([texts[i] for i in some]))
        except (MemoryError, RuntimeError) as error:
            if not failed(error) or len(some) == 1:
                raise
            most = len(some) // 2
            tokens = max(1, min(tokens, most * sizes[some[0]]))
            gc.collect()
            continue
        if len(found) != len(some):
            raise ValueError(f"{len(found)} results for {len(some)} texts")
        for i, r in zip(some, found):
            out[i] = np.asarray(r)
        at += len(some)
    return out
