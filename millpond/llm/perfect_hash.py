"""A minimal perfect hash of distinct 64-bit keys, built block by block.

A block is a share of the keys by their hash, so Spark can build each in a task of its own. Inside a block every level
has twice as many slots as keys are left; a key alone in its slot is placed there, the others go on to the next level.
The place of a key is the number of taken slots before its own, over all blocks. A key that was never put in has a place
too, so the key stored at a place is compared before it counts as found.
"""

from __future__ import annotations

BLOCK_KEYS = 1 << 16  # about as many keys in a block
SLOTS = 2  # slots of a level for each key that is left
LEVELS = 200  # each level places over half of the keys that are left, so this is never reached by distinct keys
MODULUS, FACTOR = 2**31 - 1, 48271


def block_of(keys, blocks: int):
    """The block of each key, an array; ``block_column`` is the same as a column."""
    return keys % MODULUS * FACTOR % MODULUS % blocks


def block_column(key, blocks: int):
    return (key % MODULUS * FACTOR % MODULUS % blocks).cast("int")


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slot(keys, level: int, sizes):
    """Slot of each key among ``sizes`` (a number, or one for each key) of a level."""
    import numpy as np

    start = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return (mixed(keys.astype(np.uint64) ^ start) % np.asarray(sizes, np.uint64)).astype(np.int64)


def build(keys):
    """Slots of each level, the taken slots of all levels (booleans), and the keys in the order of their places."""
    import numpy as np

    sizes, taken, order = [], [], []
    while len(keys):
        if len(sizes) >= LEVELS:
            raise ValueError("keys of a perfect hash have to be distinct")
        size = SLOTS * len(keys)
        at = slot(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        order.append(keys[own][np.argsort(at[own])])
        sizes.append(size)
        taken.append(alone)
        keys = keys[~own]
    if not sizes:
        return [], np.empty(0, bool), keys
    return sizes, np.concatenate(taken), np.concatenate(order)


class PerfectHash:
    """Places of keys, from the sizes and taken slots of consecutive blocks."""

    def __init__(self, sizes: list[list[int]], taken: list):
        import numpy as np

        depth = max(map(len, sizes), default=0)
        self.sizes = np.zeros((depth, len(sizes)), np.int64)
        for block, own in enumerate(sizes):
            self.sizes[: len(own), block] = own
        starts = np.concatenate(([0], np.cumsum(self.sizes.T.ravel())))[:-1]  # block by block, level by level
        self.starts = starts.reshape(len(sizes), depth).T if depth else self.sizes
        slots = np.concatenate(taken) if taken else np.empty(0, bool)
        self.place = np.where(slots, np.cumsum(slots, dtype=np.int32) - 1, -1).astype(np.int32)
        self.blocks = len(sizes)

    def __call__(self, keys, blocks=None):
        """Place of each key; -1 for some that were never put in. ``blocks`` are the keys' blocks, if not by hash."""
        import numpy as np

        found = np.full(len(keys), -1, np.int64)
        if not self.blocks:
            return found
        at = block_of(keys, self.blocks) if blocks is None else blocks
        todo = np.arange(len(keys))
        for level in range(len(self.sizes)):
            size = self.sizes[level][at]
            some = size > 0
            if not some.all():
                todo, keys, at, size = todo[some], keys[some], at[some], size[some]
            if not len(todo):
                break
            place = self.place[self.starts[level][at] + slot(keys, level, size)]
            hit = place >= 0
            found[todo[hit]] = place[hit]
            todo, keys, at = todo[~hit], keys[~hit], at[~hit]
        return found
