"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after a number, and names (capitalised words inside a
sentence, neighbours as one) turn into typed placeholders, all else into lower-cased words. Windows of
template tokens of documents and benchmark items are joined by hash. Matches along one diagonal of a
document and an item are one alignment; its slots are the placeholders it covers, and they are
consistent if equal names in the item stand against equal names in the document and the other way
round. Numbers and units that happen to be equal on one side say nothing and are free. An alignment is a leak if it is consistent and covers enough tokens, so a question with other
numbers or names is found, and ``exact`` tells whether all its slots have the same values.

A text is read three ways, and windows are joined within each: with the words that open a sentence as
words; with those that are no common word as names; and with names as words too, for copies in another
case. The last one only joins windows of which one has lost its case: no word in it looks like a name, or
most do. An alignment that several readings find is reported by the first. Places count tokens of the first.

Documents only send windows whose hash is set in a bit map of the benchmark's windows. The map has a
fixed size, so its broadcast is bounded; the hash join decides, whatever the map lets through.

Edge cases: null and empty texts have no windows. Items shorter than a window match nothing. Rows with
the same id are taken as parts of one document; null ids and repeated items are kept apart by value only.
Other columns are not used.
"""

import re
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from .words import mixed, sliced

WINDOW = 8
#: Least number of words, not placeholders, in a window.
LEAST_WORDS = 5
#: Template tokens that a leak covers, or all of a shorter item's.
COVERED = 13
MAP_BITS = 1 << 22
FACTOR = np.uint64(0x9FB21C651E98DF25)
SLICE_BYTES = 1 << 20
#: Units that make a placeholder after a number. Fixed values.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes lb lbs oz "
    "ml cl l liter liters litre litres gal gallon gallons s sec secs second seconds min mins minute minutes h hr "
    "hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa "
    "kpa k c f mph kph kmh percent degrees degree dollar dollars cent cents euro euros pound pounds usd eur gbp b "
    "kb mb gb tb bit bits byte bytes people students times".split()
)
#: Tokens: a number, a word, a sentence end, or a sign for a unit.
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n|%€$£°]")
ENDS, SIGNS = frozenset(".!?\n|"), frozenset("%€$£°")
NUMBER, NAME, UNIT = "\x00n", "\x00p", "\x00u"


#: Capitalised words that open a sentence and are no names. Fixed values.
OPENERS = frozenset(
    "a about above according across after afterwards again all also although always among an and another any anyone "
    "are around as assume at because before below besides between both but by calculate can choose compare compute "
    "consider could currently describe determine did do does during each either eventually evaluate every everyone "
    "explain few finally find first for from given giving had has have he hence her here hers his how however i if in "
    "initially inside instead is it its just last later let many may me meanwhile more most much my name neither next "
    "no nobody none nor not nothing now of on once one only or other our out over please prove second several she "
    "should show simplify since so solve some someone sometimes still such suppose tell than that the their them then "
    "there therefore these they third this those though through thus to today together tomorrow two under unless until "
    "up upon use using was we were what whatever when whenever where whether which while who whoever whom whose why "
    "will with within without would write yes yesterday yet you your".split()
)
#: Readings: sentence openers as words, as names, and all names as words.
OPENER_WORD, OPENER_NAME, ALL_WORDS = READINGS = range(3)


def _read(text: str) -> tuple[list[str], dict[int, str], list[int], list[int]]:
    """Tokens of a text with names as words, the values of numbers and units by position, where names
    inside a sentence are, and where sentence openers are that may be names."""
    tokens: list[str] = []
    values: dict[int, str] = {}
    names: list[int] = []
    openers: list[int] = []
    start, number = True, False
    for token in TOKEN.findall(text):
        first = token[0]
        if token.islower():  # most tokens: a word in lower case can only be itself or a unit
            lower = token
        elif first in ENDS:
            start = start or token != "." or not number
            number = False
            continue
        elif first.isdigit():
            values[len(tokens)] = token
            tokens.append(NUMBER)
            start, number = False, True
            continue
        elif first in SIGNS and not number:
            continue
        else:
            lower = token.lower()
        if number and (lower in UNITS or first in SIGNS):
            values[len(tokens)] = lower
            tokens.append(UNIT)
        else:
            if first != lower[0] and token != token.upper():
                if not start:
                    names.append(len(tokens))
                elif lower not in OPENERS:
                    openers.append(len(tokens))
            tokens.append(lower)
        start = number = False
    return tokens, values, names, openers


def templates(text: str) -> tuple[list[str], dict[int, str]]:
    """Template tokens of a text, and the values of its slots by position."""
    words, given, names, _ = _read(text)
    tokens: list[str] = []
    values: dict[int, str] = {}
    inside = set(names)
    for i, word in enumerate(words):
        if i in inside and i - 1 in inside:
            values[len(tokens) - 1] += " " + word
            continue
        if i in inside or i in given:
            values[len(tokens)] = given.get(i, word)
        tokens.append(NAME if i in inside else word)
    return tokens, values


class Codes(dict):
    """64-bit code of every token seen; forgets all when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


def _hashes(codes: np.ndarray, window: int, salt: int) -> np.ndarray:
    """Hash of each ``window`` neighbouring codes, put together from runs of powers of two."""
    n = max(len(codes) - window + 1, 0)
    value, at, size, run = np.full(n, salt, np.uint64), 0, 1, codes
    while size <= window:
        if window & size:
            value = mixed(value * FACTOR + run[at : at + n])
            at += size
        if 2 * size <= window:
            run = mixed(run[:-size] * FACTOR + run[size:])
        size *= 2
    return value


def _windows(batches, bits: np.ndarray | None, window: int, least_words: int):
    """Windows of all readings whose hash the bit map has; see SCHEMA."""
    known = Codes()
    name_code = np.uint64(known[NAME])
    slot_codes = np.array([known[t] for t in (NUMBER, UNIT)], np.uint64)
    for batch in batches:
        for part in sliced(batch, "text", SLICE_BYTES):
            cut = [_read(text or "") for text in part.column("text").to_pylist()]
            lengths = np.array([len(t) for t, *_ in cut], np.int64)
            begin = np.cumsum(lengths) - lengths
            total = int(lengths.sum())
            all_codes = np.fromiter(map(known.__getitem__, chain.from_iterable(t for t, *_ in cut)), np.uint64, total)
            owner = np.repeat(np.arange(len(cut)), lengths)
            inner, opener = np.zeros(total, bool), np.zeros(total, bool)
            inner[[b + i for b, c in zip(begin.tolist(), cut, strict=True) for i in c[2]]] = True
            opener[[b + i for b, c in zip(begin.tolist(), cut, strict=True) for i in c[3]]] = True
            filled = np.isin(all_codes, slot_codes)
            looks = np.concatenate([[0], np.cumsum(inner | opener)])
            for reading in READINGS:
                name = np.zeros(total, bool) if reading == ALL_WORDS else inner | opener if reading else inner
                # A name that follows a name in its sentence is a part of it.
                keep = ~inner | ~np.concatenate([[False], name[:-1]])[:total]
                if reading == OPENER_WORD:
                    home = np.cumsum(keep) - 1
                    home_begin = np.concatenate([home, [0]])[np.minimum(begin, total)]
                source = np.flatnonzero(keep) if reading != ALL_WORDS else np.arange(total)
                codes = np.where(name[source], name_code, all_codes[source])
                slot = name[source] | filled[source]
                doc = owner[source]
                sizes = np.bincount(doc, minlength=len(cut))
                starts = np.cumsum(sizes) - sizes
                value = _hashes(codes, window, window + (reading << 32))
                n = len(value)
                words = np.concatenate([[0], np.cumsum(~slot)])
                some = words[window:][:n] - words[:n] >= least_words
                if bits is not None:
                    at = (value % np.uint64(MAP_BITS)).astype(np.int64)
                    some &= (bits[at >> 3] >> (at & 7)) & 1 == 1
                at = np.flatnonzero(some)
                at = at[doc[at] == doc[at + window - 1]]
                owns = doc[at]
                plain = np.ones(len(at), bool)
                if reading == ALL_WORDS:
                    caps = looks[at + window] - looks[at]
                    plain = (caps == 0) | (2 * caps > words[at + window] - words[at])
                ends = np.append(source[1:], total)
                slots, values, named = [], [], []
                for i, d in zip(at.tolist(), owns.tolist(), strict=True):
                    tokens, given, first = cut[d][0], cut[d][1], int(begin[d])
                    ks = np.flatnonzero(slot[i : i + window]).tolist()
                    spans = [(int(source[i + k]) - first, int(ends[i + k]) - first) for k in ks]
                    slots.append(ks)
                    named.append(name[[int(source[i + k]) for k in ks]].tolist() if ks else [])
                    values.append([given[a] if a in given else " ".join(tokens[a:b]) for a, b in spans])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id").take(pa.array(owns, pa.int64())),
                        "window": pa.array(value[at].view(np.int64)),
                        "place": pa.array(at - starts[owns], pa.int32()),
                        "length": pa.array(sizes[owns], pa.int32()),
                        "slots": pa.array(slots, pa.list_(pa.int32())),
                        "values": pa.array(values, pa.list_(pa.string())),
                        "named": pa.array(named, pa.list_(pa.bool_())),
                        "reading": pa.array(np.full(len(at), reading), pa.int32()),
                        "plain": pa.array(plain),
                        "home": pa.array(home[source[at]] - home_begin[owns], pa.int32()),
                    }
                )


#: ``place`` and ``length`` count tokens of the reading, ``home`` those of the first; ``plain`` windows join any.
SCHEMA = (
    "id long, window long, place int, length int, slots array<int>, values array<string>, "
    "named array<boolean>, reading int, plain boolean, home int"
)


def windows(texts: DataFrame, bits: np.ndarray | None = None, window: int = WINDOW, least_words: int = LEAST_WORDS):
    """Template windows of ``texts(id, text)``."""
    return texts.mapInArrow(partial(_windows, bits=bits, window=window, least_words=least_words), SCHEMA)


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bit map of the windows' hashes: MAP_BITS bits, however many windows there are."""
    # Same as the unsigned remainder in numpy, since MAP_BITS is a power of two.
    at = F.col("window").bitwiseAND(F.lit(MAP_BITS - 1))
    words = (
        hashes.select(F.shiftright(at, 5).alias("word"), F.expr(f"shiftleft(1L, cast(window & 31 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    out = np.zeros(MAP_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    least_words: int = LEAST_WORDS,
    covered: int = COVERED,
) -> DataFrame:
    """(doc_id, item_id, place, item_place, n_covered, n_slots, exact): each consistent alignment that covers
    at least ``covered`` tokens, or the whole item if it is shorter."""
    items = windows(benchmark.select(F.col("item_id").cast("long").alias("id"), "text"), None, window, least_words)
    bits = bit_map(items.select("window"))
    found = windows(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), bits, window, least_words)
    d, b = found.alias("d"), items.distinct().alias("b")
    pairs = d.join(b, (F.col("d.window") == F.col("b.window")) & (F.col("d.plain") | F.col("b.plain"))).select(
        F.col("d.id").alias("doc_id"),
        F.col("b.id").alias("item_id"),
        F.col("b.reading").alias("reading"),
        F.col("d.home").alias("doc_home"),
        F.col("b.home").alias("item_home"),
        (F.col("d.place") - F.col("b.place")).alias("shift"),
        F.col("b.place").alias("at"),
        F.col("b.length").alias("length"),
        F.arrays_zip(
            F.transform("b.slots", lambda k: k + F.col("b.place")).alias("place"),
            F.col("b.values").alias("asked"),
            F.col("d.values").alias("given"),
            F.col("b.named").alias("named"),
        ).alias("slots"),
    )
    # An alignment has at most the item's tokens as members, so its sets are bounded by one item.
    slot = F.explode_outer("slots")
    each = pairs.withColumn("slot", slot).drop("slots")
    runs = each.groupBy("doc_id", "item_id", "reading", "shift").agg(
        F.min("doc_home").alias("place"),
        F.min("item_home").alias("item_place"),
        F.max("length").alias("length"),
        F.array_sort(F.collect_set("at")).alias("starts"),
        F.collect_set("slot").alias("filled"),
    )
    names = F.filter("filled", lambda s: s["named"])
    one_way = F.size(F.array_distinct(F.transform(names, lambda s: s["asked"])))
    other_way = F.size(F.array_distinct(F.transform(names, lambda s: s["given"])))
    both = F.size(F.array_distinct(F.transform(names, lambda s: F.struct(s["asked"], s["given"]))))
    # Each window adds the tokens that earlier ones do not cover.
    tokens = F.aggregate(
        "starts",
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(x - acc["last"], F.lit(window))).alias("sum")),
        lambda acc: acc["sum"],
    )
    diagonal = Window.partitionBy("doc_id", "item_id", F.col("place") - F.col("item_place"))
    return (
        runs.withColumns({"n_covered": tokens, "n_slots": F.size("filled")})
        .where((F.col("n_covered") >= F.least(F.lit(covered), F.col("length"))) & (one_way == both) & (other_way == both))
        .withColumn("first", F.min("reading").over(diagonal))
        .where(F.col("reading") == F.col("first"))
        .select(
            "doc_id",
            "item_id",
            "place",
            "item_place",
            "n_covered",
            "n_slots",
            F.forall("filled", lambda s: s["asked"] == s["given"]).alias("exact"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without those that hold a leak. A row without an id can't be named and stays."""
    found = leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("_leaked")).distinct()
    bad = written(found, "leaks")  # Spark broadcasts it if it is small, and can split the join if not
    return docs.join(bad, docs["doc_id"] == F.col("_leaked"), "left_anti")
