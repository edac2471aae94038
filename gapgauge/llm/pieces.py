"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised as the model does (a space in front, spaces as the mark
U+2581) and cut into units at places that no piece crosses: before a mark that
follows another character, and between letters and other characters; both are
checked against the model's pieces. Only different units are worked on. Their
substrings up to the longest piece are exploded and equi-joined to the piece
table, the matching edges are grouped by unit, and one higher-order aggregate
folds each unit's lattice into its pieces:

* ``viterbi`` for unigram models: the path with the highest sum of scores;
* ``merge`` for merge-rank models: of the edges that join two neighbouring
  pieces the one of highest score is applied, leftmost first, until none is left.

Scores of a merge-rank model are ranks, whose sums mean nothing, so the fold
follows the model's kind. Characters without a piece become their UTF-8 byte
pieces. A unit longer than LONGEST characters is encoded by the library.

Every scanned block of input files has a dictionary of its own units. It is
written below the shared folder and read by the tasks that encode the block, so
texts are never shuffled and no task holds more than the units of one block.
Input that is not a plain scan of files is written first.

NULL text: NULL ids; empty text: no ids. Decoding gives back the text, except
that U+2581 in a text becomes a space, as in the library. Repeated rows are
encoded alike; all other columns are kept, ``ids`` is replaced. No row: no row.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge.llm.common import opened, runs, scratch_path, settled, tokenizer_path

MARK = "▁"


def letter_class() -> str:
    """Ranges of all letters and combining marks, for a character class."""
    places = np.array([c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LM"])
    cuts = np.flatnonzero(np.diff(places) > 1)
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(places[np.r_[0, cuts + 1]], places[np.r_[cuts, len(places) - 1]], strict=True))


LETTERS = letter_class()
UNIT = re.compile(f" *[{LETTERS}]+| *[^{LETTERS} ]+| +")
#: The same for texts of Latin-1 characters only, whose short class matches faster.
LATIN_LETTERS = "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == "L")
LATIN_UNIT = re.compile(f" *[{LATIN_LETTERS}]+| *[^{LATIN_LETTERS} ]+| +")
#: Characters of a unit whose cuts fit the bits of one number.
LONGEST = 62
#: Score of a character without a piece, below any path of pieces within a unit.
UNKNOWN = -1e12


@dataclass(frozen=True)
class PieceParams:
    path: str | None = None
    fold: str = "merge"

    @property
    def model(self) -> str:
        return self.path or tokenizer_path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> pd.DataFrame:
    """piece, id, score of the pieces that stand for text; checks where units are cut."""
    model = processor(path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    out = pd.DataFrame({"piece": [model.id_to_piece(i).replace(MARK, " ") for i in ids], "id": ids, "score": [model.get_score(i) for i in ids]})
    crossing = [p for p in out["piece"] if len(UNIT.findall(p)) != 1]
    if crossing:
        raise ValueError(f"pieces that cross the cuts between units: {crossing[:5]}")
    return out


@lru_cache(maxsize=2)
def wide_pieces(path: str) -> pd.DataFrame:
    """piece, id, score, place, halt of the pieces of two or more characters.

    ``place`` numbers the different scores, best first. ``halt`` marks pieces
    that can be joined with a neighbour to a piece that is not worse.
    """
    known = pieces_of(path)
    out = known[known["piece"].str.len() > 1].copy()
    out["place"] = np.unique(-out["score"].to_numpy(), return_inverse=True)[1]
    if len(out) and max(out["place"].max(), out["id"].max()) >= 1 << 20:
        raise ValueError("more pieces than an edge has room for")
    places, halting = dict(zip(out["piece"], out["place"].tolist(), strict=True)), set()
    for piece, place in places.items():
        for cut in range(1, len(piece)):
            parts = piece[:cut], piece[cut:]
            if all(len(part) == 1 or part in places for part in parts):
                halting.update(part for part in parts if places.get(part, -1) >= place)
    out["halt"] = out["piece"].isin(halting)
    return out


@lru_cache(maxsize=4)
def by_character(path: str, column: str, missing: float) -> str:
    """SQL array by code point of the ids or scores of single characters.

    It becomes one constant of the plan, which is looked up by position.
    """
    known = pieces_of(path)
    single = known[known["piece"].str.len() == 1]
    places = [ord(c) for c in single["piece"]]
    values = np.full(max(places) + 1, missing, dtype=known[column].dtype)
    values[places] = single[column]
    kind = "int" if column == "id" else "double"
    return f"cast(split('{','.join(map(str, values.tolist()))}', ',') as array<{kind}>)"


@lru_cache(maxsize=2)
def by_place(path: str) -> str:
    """SQL array of the scores of wide pieces by their place."""
    scores = np.unique(-wide_pieces(path)["score"].to_numpy())
    return f"cast(split('{','.join(map(str, (-scores).tolist()))}', ',') as array<double>)"


def units_of(text: str) -> list[str]:
    """Units of a text, with a space for the model's mark."""
    if not text:
        return []
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return UNIT.findall(" " + text.replace(MARK, " "))
    return LATIN_UNIT.findall(" " + text)


def block_units(docs: DataFrame) -> DataFrame:
    """block, unit: the different units of each scanned block (block, text)."""

    def collect(batches):
        block, seen = None, set()
        for batch in batches:
            for part in text_slices(batch):
                for own, text in zip(part["block"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if own != block:
                        yield from emitted(block, seen)
                        block, seen = own, set()
                    seen.update(units_of(text or ""))
        yield from emitted(block, seen)

    def emitted(block, seen):
        while seen:
            units = [seen.pop() for _ in range(min(len(seen), 20_000))]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(units), pa.int64()), "unit": pa.array(units, pa.string())})

    return docs.select("block", "text").mapInArrow(lean(collect), "block long, unit string")


def lean(task):
    """The task, giving back at its end what Arrow holds in reserve; idle workers keep their size."""

    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


def text_slices(batch: pa.RecordBatch, limit: int = 1 << 20):
    """Runs of rows of a batch with about ``limit`` bytes of text (one row at least)."""
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for begin, end in zip(*runs(np.cumsum(sizes) // limit), strict=True):
            yield batch.slice(int(begin), int(end - begin))


def lattice_edges(units: DataFrame, p: PieceParams) -> DataFrame:
    """unit, blocks, edges of the units of up to LONGEST characters.

    An edge is one number, place << 33 | start << 27 | id << 7 | halt << 6 | length,
    so plain order is best score first, then leftmost. The piece table is bounded by
    the model and joined by a number, the hash of the piece with its length in the last
    six bits; the rest of the unit must then begin with the piece. Its empty entry
    keeps every unit and is the one row that carries the blocks. Units come hashed by
    unit, so grouping their edges needs no shuffle.
    """
    spark, known = units.sparkSession, wide_pieces(p.model)
    known = known[known["piece"].str.len() <= LONGEST]
    rows = [(piece, int(place) << 33 | int(i) << 7 | int(halt) << 6 | len(piece)) for piece, place, i, halt in known[["piece", "place", "id", "halt"]].itertuples(index=False)]
    table = spark.createDataFrame([*rows, ("", None)], "piece string, edge long")
    table = table.withColumn("key", piece_key(F.col("piece"), F.char_length("piece")))
    longest = int(known["piece"].str.len().max()) if len(known) else 1
    size = F.char_length("unit")
    first = F.when(size <= LONGEST, F.sequence(F.lit(0), size)).otherwise(F.array(size))
    starts = units.select("unit", "blocks", size.alias("size"), F.explode(first).alias("start"))
    # the last place gives the empty entry; single characters need no edge
    lengths = F.when(F.col("start") == F.col("size"), F.array(F.lit(0))).when(F.col("start") + 1 < F.col("size"), F.sequence(F.lit(2), F.least(F.col("size") - F.col("start"), F.lit(longest))))
    once = F.when(F.col("start") == F.col("size"), F.col("blocks")).alias("blocks")
    rest = F.expr(f"substr(unit, start + 1, {longest})").alias("rest")
    cut = starts.select("unit", once, "start", rest, F.explode(lengths).alias("length")).withColumn("key", piece_key(F.expr("substr(rest, 1, length)"), F.col("length")))
    edges = cut.join(F.broadcast(table), (cut["key"] == table["key"]) & F.startswith("rest", "piece"))
    packed = F.expr("edge | shiftleft(cast(start as bigint), 27)").alias("edge")
    return edges.select("unit", "blocks", packed).groupBy("unit").agg(F.first("blocks", ignorenulls=True).alias("blocks"), F.sort_array(F.collect_list("edge")).alias("edges"))


def piece_key(piece: Column, length: Column) -> Column:
    """Hash of a piece with its length in the last six bits, so that lengths never mix."""
    return F.xxhash64(piece).bitwiseAND(F.lit(-64).cast("long")).bitwiseOR(length.cast("long"))


#: Fields of an edge.
START, LENGTH, ID, PLACE = "cast(shiftright(e, 27) & 63 as int)", "cast(e & 63 as int)", "cast(shiftright(e, 7) & 1048575 as int)", "cast(shiftright(e, 33) as int)"
#: Bits of its two ends and those between them, counted from its start; the cuts of the unit there.
ENDS, INSIDE = f"(shiftleft(1L, {LENGTH}) + 1)", f"(shiftleft(1L, {LENGTH}) - 2)"
HERE = f"(shiftright(cuts, {START}) & ~shiftleft(-2L, {LENGTH}))"


def merge_cuts() -> Column:
    """Bits of the places where the unit stays cut (fold of best merges).

    A pass takes the edges in order and applies those that join two neighbouring
    pieces. What an applied edge makes possible is worse and comes later in the
    pass, unless its piece halts: then the sign bit is set, the rest of the pass
    is skipped and the next one begins at the best edge. Cuts only go, so an
    edge that lost an end, or all within it, is left out of the later passes.
    """
    begin = "struct(~shiftleft(-1L, char_length(unit) + 1) as cuts, edges as edges)"
    joins = f"cuts >= 0 and bit_count({HERE}) = 3 and ({HERE} & {ENDS}) = {ENDS}"
    once = f"aggregate(s.edges, s.cuts, (cuts, e) -> if({joins}, cuts & ~shiftleft({INSIDE}, {START}) | shiftleft(e & 64L, 57), cuts))"
    left = f"filter(s.edges, e -> cuts < 0 and bit_count({HERE}) > 2 and ({HERE} & {ENDS}) = {ENDS})"
    then = f"if(size(s.edges) = 0, s, transform(array({once}), cuts -> struct(cuts & {(1 << 63) - 1}L as cuts, {left} as edges))[0])"
    return F.expr(f"if(size(edges) = 0, ~shiftleft(-1L, char_length(unit) + 1), aggregate(sequence(2, char_length(unit)), {begin}, (s, i) -> {then}, s -> s.cuts))")


def viterbi_cuts(p: PieceParams) -> Column:
    """Bits of the places where the best path cuts the unit.

    The state holds, for every place, the score of the best path to it and the
    bits of its cuts. A single character costs its own score, or more than any
    piece if it has none.
    """
    own = f"coalesce(get({by_character(p.model, 'score', UNKNOWN)}, ascii(substr(unit, i, 1))), {UNKNOWN}D)"
    unknown = f"(element_at(state, i).score + {own})"
    ways = f"transform(filter(edges, e -> {START} + {LENGTH} = i), e -> struct(element_at(state, {START} + 1).score + get({by_place(p.model)}, {PLACE}) as score, element_at(state, {START} + 1).cuts | shiftleft(1L, i) as cuts))"
    alone = f"array(struct({unknown} as score, element_at(state, i).cuts | shiftleft(1L, i) as cuts))"
    best = f"array_max(concat({ways}, {alone}))"
    start = "array(struct(0.0D as score, 1L as cuts))"
    return F.expr(f"element_at(aggregate(sequence(1, char_length(unit)), {start}, (state, i) -> concat(state, array({best}))), -1).cuts")


def fold_units(lattice: DataFrame, p: PieceParams) -> DataFrame:
    """unit, blocks, ids: the pieces of every unit."""
    first_byte = processor(p.model).piece_to_id("<0x00>")
    cuts = merge_cuts() if p.fold == "merge" else viterbi_cuts(p)
    # one number for each piece, start << 32 | byte << 28 | id, puts them in order
    wide = f"transform(filter(edges, e -> {HERE} = {ENDS}), e -> shiftleft(cast({START} as bigint), 32) | {ID})"
    part = "substr(unit, i + 1, 1)"
    known = f"coalesce(get({by_character(p.model, 'id', -1)}, ascii({part})), -1)"
    octets = f"transform(sequence(1, octet_length({part})), b -> shiftleft(cast(i as bigint), 32) | shiftleft(cast(b as bigint), 28) | (cast(conv(substr(hex(encode({part}, 'UTF-8')), 2 * b - 1, 2), 16, 10) as bigint) + {first_byte}))"
    # a one-element array binds a value that an expression uses several times
    one = f"transform(array({known}), id -> if(id >= 0, array(shiftleft(cast(i as bigint), 32) | id), {octets}))[0]"
    # two cuts side by side are a piece of one character
    alone = f"if((cuts & shiftright(cuts, 1)) = 0, array(), flatten(transform(filter(sequence(0, char_length(unit) - 1), i -> (shiftright(cuts, i) & 3) = 3), i -> {one})))"
    ids = f"transform(sort_array(concat({wide}, {alone})), x -> cast(x & 268435455 as int))"
    cuts = F.when(F.char_length("unit") <= LONGEST, cuts)
    folded = lattice.withColumn("cuts", cuts).select("unit", "blocks", F.when(F.col("cuts").isNotNull(), F.expr(ids)).alias("ids"))
    folded = settled(folded, "piece-units")

    def by_library(batches):
        model = processor(p.model)
        for batch in batches:
            yield batch.assign(ids=[long_unit(model, u) for u in batch["unit"]])

    long = folded.filter("ids is null").select("unit", "blocks")
    return folded.filter("ids is not null").unionByName(long.mapInPandas(by_library, "unit string, blocks array<long>, ids array<int>"))


def long_unit(model, unit: str) -> list[int]:
    """Pieces of a unit by the library, which puts a space in front itself.

    A unit without that space is encoded behind a line break, which no piece joins.
    """
    if unit.startswith(" "):
        return model.encode(unit[1:])
    return model.encode("\n" + unit)[len(model.encode("\n")) :]


def encode_documents(docs: DataFrame, p: PieceParams = PieceParams(), verify: bool = False, keep: list[str] | None = None, spread: int = 0) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of each whole text.

    With ``verify`` also ``restored``: whether the ids decode to the text.
    ``keep`` names the columns that are wanted besides; texts that nobody reads
    again need not come back from the encoding tasks. ``spread``, if any, deals
    the units to that many times the usual partitions: a unit becomes a row for
    each of its edges, and smaller tasks need less memory for about a tenth more
    shuffle.
    """
    docs = docs.drop("ids", *(["restored"] if verify else []))
    if not docs.select(F.input_file_name().alias("file")).filter("file = ''").isEmpty():
        docs = settled(docs, "piece-documents")
    names, path = docs.columns if keep is None else keep, p.model
    # a block is a hash of the scanned file and the place in it
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("block")
    scanned = docs.select(block, docs["text"].alias("text"), carried(docs, [c for c in names if c != "text"]))
    units = block_units(scanned)
    if spread:
        units = units.repartition(spread * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    units = units.groupBy("unit").agg(F.collect_set("block").alias("blocks"))
    folder = scratch_path(docs.sparkSession, "piece-blocks")
    each = fold_units(lattice_edges(units, p), p).select("unit", "ids", F.explode("blocks").alias("block"))
    each.repartition("block").write.partitionBy("block").parquet(folder)

    with_text = "text" in names
    schema = T.StructType([scanned.schema["rest"]])
    if with_text:
        schema = schema.add("text", "string")
    schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if verify:
        schema = schema.add("restored", "boolean")

    def encode(batches):
        block, known, octets = None, {}, pa.array(piece_bytes(path), pa.binary()) if verify else None
        for batch in batches:
            for part in text_slices(batch):
                ids, texts = [], part["text"].to_pylist()
                for own, text in zip(part["block"].to_pylist(), texts, strict=True):
                    if not text:
                        ids.append(None if text is None else b"")
                        continue
                    if own != block:
                        block, known = own, {}
                        known = block_dictionary(f"{folder}/block={own}")
                    ids.append(b"".join([known[u] for u in units_of(text)]))
                out = {"rest": part["rest"], **({"text": part["text"]} if with_text else {}), "ids": id_lists(ids)}
                if verify:
                    out["restored"] = pa.array([not text or found == text for text, found in zip(texts, texts_of(out["ids"], octets), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    found = scanned.mapInArrow(lean(encode), schema)
    kept = [F.col("text") if c == "text" else F.col("rest").getField("own").getField(c).alias(c) for c in names]
    return found.select(*kept, "ids", *(["restored"] if verify else []))


def carried(docs: DataFrame, names: list[str]) -> Column:
    """Columns that tasks hand on unseen, as one struct ``rest`` with the struct ``own``."""
    own = [F.struct(*(F.col(f"`{c}`") for c in names)).alias("own")] if names else []
    return F.struct(F.lit(0).alias("none"), *own).alias("rest")


def id_lists(packed: list[bytes | None]) -> pa.Array:
    """Lists of ids from their bytes; None stays NULL."""
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in packed)])
    offsets = pa.array(ends.astype(np.int32))
    missing = pa.array([x is None for x in packed], pa.bool_())
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32)), mask=missing)


def block_dictionary(folder: str) -> dict[str, bytes]:
    """Units of one block with their ids as packed numbers."""
    from pyarrow import dataset

    store, path = opened(folder)
    out = {}
    for batch in dataset.dataset(path, filesystem=store, format="parquet").to_batches(columns=["unit", "ids"], batch_size=16_384, batch_readahead=1, fragment_readahead=1):
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
        at = (4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())).tolist()
        out.update((unit, flat[at[i] : at[i + 1]]) for i, unit in enumerate(batch.column("unit").to_pylist()))
    return out


def piece_bytes(path: str) -> list[bytes]:
    """What every piece stands for."""
    model = processor(path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.get_piece_size())]


def decoded(ids: np.ndarray, octets: list[bytes]) -> str:
    """Text of the ids, without the space that encoding put in front."""
    return b"".join([octets[i] for i in np.asarray(ids).tolist()]).decode("utf-8", "replace")[1:]


def texts_of(ids: pa.ListArray, octets: pa.BinaryArray) -> list[str]:
    """Texts of lists of ids, without the space that encoding put in front; NULL gives an empty one."""
    parts = octets.take(ids.flatten())
    ends = np.append(0, np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64))
    data = memoryview(parts.buffers()[2]) if len(parts) else b""
    at = ends[ids.offsets.to_numpy()].tolist()
    return [bytes(data[a:b]).decode("utf-8", "replace")[1:] for a, b in zip(at, at[1:])]


def decode_documents(encoded: DataFrame, p: PieceParams = PieceParams(), column: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ``ids`` stand for."""
    names, path = encoded.drop(column).columns, p.model
    sent = encoded.select(F.col("ids"), carried(encoded, names))

    def decode(batches):
        octets = piece_bytes(path)
        for batch in batches:
            texts = [None if ids is None else decoded(np.array(ids, np.int32), octets) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["rest"], pa.array(texts, pa.string())], names=["rest", "text"])

    found = sent.mapInArrow(decode, T.StructType([sent.schema["rest"]]).add("text", "string"))
    return found.select(*(F.col("rest").getField("own").getField(c).alias(c) for c in names), F.col("text").alias(column))
