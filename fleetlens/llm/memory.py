"""Python workers outlive their tasks; what a group needed for a moment is given back to the system after it."""

import ctypes
import gc
import sys

import pyarrow as pa


def give_back() -> None:
    """Free pages of the C heap and of Arrow's pool go back to the system, where it can do that."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def fresh_start() -> None:
    """Drop what earlier tasks of this worker left.

    Functions travel by value, so every task has globals of its own, with tables and tokenizers kept in them. They
    hang in cycles, which Python would collect by their number and not by their size.
    """
    gc.collect()
    give_back()


def lean(function):
    """A function of one table that begins with a clean worker and gives back what it used."""
    begun = []

    def run(table):
        if not begun:
            begun.append(True)
            fresh_start()
        result = function(table)
        give_back()
        return result

    return run


def lean_beside(function):
    """The same for a function of two tables."""
    begun = []

    def run(table, other):
        if not begun:
            begun.append(True)
            fresh_start()
        result = function(table, other)
        give_back()
        return result

    return run
