"""Transcripts to canonical turns: a hidden Markov model over speaker markers and line features, decoded by Viterbi.

A state is a role, at the first line of a turn or inside it. Lines say by their marker (a role's name, a bare marker, none),
their kind (blank, question, list, or how long) and whether a piece of the transcript begins with them how likely each state
is. The model's tables are counts of a bounded sample of turns whose roles are known, written in every style of markers and
without any. Pieces of transcripts are ranged by conversation and order, so that a long conversation runs over several tasks.
A conversation that begins and ends inside a task is decoded there. What stands at either end of a task may go on in the next
one: such a segment gives a table of the best scores from each state before it to each state at its end, these tables (two a
task at most) are chained by conversation, and the segment is decoded between the states that the chain names. The result is
that of one Viterbi run over the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, store, table

ROLES = ("system", "user", "assistant")
N = len(ROLES)
#: Names of speakers, by role.
NAMES = {
    "system": "system sys",
    "user": "user human customer client student interviewer prompter prompt instruction question q usr",
    "assistant": "assistant ai bot chatbot agent model gpt response answer a assistent",
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role].split()}
_ANY = r"(?:speaker|person|participant|voice)\s*\w{1,3}"
_WORD = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(
    rf"\s*(?:<\|im_start\|>\s*(?P<im>{_WORD})\b|<\|(?P<bar>{_WORD})\|>|\[(?P<box>{_WORD})\]:?|#{{1,4}}\s*(?P<head>{_WORD})\s*:?\s*$|(?:\*\*|#{{1,4}}\s*)?(?P<plain>{_WORD})(?:\*\*)?\s*:(?:\*\*)?|(?P<any>(?:{_ANY})\s*:|[-–—]\s+))\s*",
    re.IGNORECASE,
)
_CLOSER = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|</s>)\s*$")

NAMED, BARE, NO_MARK = 0, N, N + 1
KINDS = ("blank", "question", "list", "20", "40", "60", "80", "120", "160", "240", "320", "more")
#: Lines of other kinds by their characters, up to each of these.
SIZES = (20, 40, 60, 80, 120, 160, 240, 320)
#: Turns that the model is fitted on, at most: those of the conversations of the least hashes.
MAX_TURNS = 20_000
#: Segments whose ends are broadcast; more are joined by shuffle.
MAX_BROADCAST_ENDS = 200_000
#: Codes of a line: marker, kind, and whether a piece begins with it.
CODES = (N + 2) * len(KINDS) * 2


@dataclass
class Model:
    """Logs of chances: first state, state after each state, code by state; states 0..N-1 begin a turn, N..2N-1 go on in it."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit(conversations: list[list[tuple[str, str]]]) -> Model:
    """Counts over conversations of turns (role, text), each one piece; one more of everything that has no count, in proportion.

    Every conversation counts once in each style of markers and once without. Turns of other roles are passed over.
    """
    first, after, ends = np.full(N, 0.5), np.full((N, N), 0.5), np.ones((N, 2))
    mark, kind, fresh = np.full((2 * N, N + 2), 0.5), np.full((2 * N, len(KINDS)), 0.5), np.full((2 * N, 2), 0.5)
    for r in range(N):  # another role's name is less likely than an order of roles that hasn't been seen
        mark[r, [x for x in range(N) if x != r]] = 0.002
    for turns in conversations:
        before = None
        for role, text in turns:
            if role not in ROLES:
                continue
            r = ROLES.index(role)
            if before is None:
                first[r] += 1
            else:
                after[before, r] += 1
            before = r
            for style in STYLES:
                for i, line in enumerate((style[r] + text).split("\n")):
                    m, k = divmod(read_line(line)[0] // 2, len(KINDS))
                    state = r if i == 0 else N + r
                    mark[state, m] += 1 / len(STYLES)
                    kind[state, k] += 1 / len(STYLES)
                    fresh[state, int(i == 0)] += 1 / len(STYLES)
                ends[r] += np.array([1, i]) / len(STYLES)  # lines that end a turn, and others
    share = lambda x: x / x.sum(-1, keepdims=True)
    first, after, ends = share(first), share(after), share(ends)
    step = np.zeros((2 * N, 2 * N))
    for s in range(2 * N):
        step[s, :N] = ends[s % N, 0] * after[s % N]
        step[s, N + s % N] = ends[s % N, 1]
    emit = share(mark)[:, :, None, None] * share(kind)[:, None, :, None] * share(fresh)[:, None, None, :]
    with np.errstate(divide="ignore"):
        return Model(np.log(np.concatenate([first, np.full(N, 1e-9)])), np.log(step), np.log(emit.reshape(2 * N, CODES).T))


START = 2 * N  # the entry of a segment's table that stands for "nothing comes before it"


def read_line(line: str, fresh: bool = False) -> tuple[int, str]:
    """(code of its marker and kind and whether a piece begins with it, the line without its marker)."""
    mark, rest = NO_MARK, _CLOSER.sub("", line)
    if m := _MARKER.match(rest):
        word = next((m[g] for g in ("im", "bar", "box", "head", "plain") if m[g]), None)
        mark = _ROLE_OF[word.lower()] if word else BARE
        rest = rest[m.end() :]
    bare = rest.strip()
    if not bare:
        kind = 0
    elif bare[-1] in "?？":
        kind = 1
    elif re.match(r"[-*•]\s|\d{1,2}[.)]\s|```", bare):
        kind = 2
    else:
        kind = 3 + sum(len(bare) > n for n in SIZES)
    return (mark * len(KINDS) + kind) * 2 + fresh, rest


def viterbi(model: Model, codes: np.ndarray, enter: int = START, leave: int = -1) -> np.ndarray:
    """The best states of lines, given the state before them (START: none) and the last one's (-1: free); of ties, the least state."""
    score = (model.first if enter == START else model.step[enter]) + model.emit[codes[0]]
    back = np.zeros((len(codes), 2 * N), "int8")
    for t in range(1, len(codes)):
        each = score[:, None] + model.step
        back[t] = each.argmax(0)
        score = each.max(0) + model.emit[codes[t]]
    states = np.empty(len(codes), "int8")
    states[-1] = leave if leave >= 0 else score.argmax()
    for t in range(len(codes) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def segment_table(model: Model, codes: np.ndarray) -> np.ndarray:
    """(2N + 1) x 2N: the best score from each state before the lines, or START, to each state of the last line."""
    score = np.vstack([model.step, model.first]) + model.emit[codes[0]]
    for c in codes[1:]:
        score = (score[:, :, None] + model.step[None]).max(1) + model.emit[c]
    return score


def chain(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, last state) of each segment of a conversation, from their tables in order."""
    score, back = tables[0][START], []
    for t in tables[1:]:
        each = score[:, None] + t[:START]
        back.append(each.argmax(0))
        score = each.max(0)
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    states.reverse()
    return list(zip([START, *states[:-1]], states))


ROW = "conv string, ord long, seq long, line int, role string, starts boolean, text string, part int, seg int, codes array<int>, lines array<string>, scores array<double>"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.float64())]
_NAMES = [x.split()[0] for x in ROW.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _fragments(pieces: list[tuple], states: np.ndarray, part: int, seg: int) -> Iterator[tuple]:
    """A row for each run of lines of a turn within a piece (conv, ord, seq, codes, lines)."""
    at = 0
    for conv, order, seq, codes, lines in pieces:
        own = states[at : at + len(codes)]
        at += len(codes)
        edges = [0, *(i for i in range(1, len(own)) if own[i] < N), len(own)]
        for a, b in zip(edges, edges[1:]):
            alone = own[a] < N and b - a > 1 and not lines[a].strip() and codes[a] // 2 // len(KINDS) != NO_MARK  # a marker on a line of its own
            yield conv, order, seq, a, ROLES[own[a] % N], bool(own[a] < N), "\n".join(lines[a + alone : b]), part, seg, None, None, None


def _parse(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: fragments of conversations inside this task; of the first and last one, pieces and a table of scores.

        A task holds the pieces of one conversation at a time, which are its own share of the input at most.
        """
        part, seg, now, held, out = TaskContext.get().partitionId(), 0, None, [], []

        def undecided() -> None:
            out.extend((*p[:3], i, None, None, None, part, seg, *p[3:], None) for i, p in enumerate(held))  # line: the place in the segment
            scores = segment_table(model, np.concatenate([p[3] for p in held])).ravel().tolist()
            out.append((held[0][0], None, None, None, None, None, None, part, seg, None, None, scores))

        for b in batches:
            for conv, order, seq, text in zip(*(b.column(c).to_pylist() for c in ("conv", "ord", "seq", "text"))):
                if held and conv != now:
                    if seg == 0:
                        undecided()
                    else:
                        out.extend(_fragments(held, viterbi(model, np.concatenate([p[3] for p in held])), part, seg))
                    held, seg = [], seg + 1
                    if len(out) > 1000:
                        yield _batch(out)
                        out = []
                now = conv
                codes, lines = zip(*(read_line(x, i == 0) for i, x in enumerate((text or "").replace("\r\n", "\n").split("\n"))))
                held.append((conv, order, seq, np.array(codes), list(lines)))
        if held:
            undecided()
        if out:
            yield _batch(out)

    return run


def _ends(segments: pd.DataFrame) -> pd.DataFrame:
    """(part, seg, enter, leave) of the segments of one conversation; of a segment it has one small table, and a task makes two at most."""
    s = segments.sort_values(["part", "seg"])
    both = chain([np.array(x).reshape(START + 1, START) for x in s["scores"]])
    return pd.DataFrame({"part": s["part"], "seg": s["seg"], "enter": [a for a, _ in both], "leave": [b for _, b in both]})


def _decode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of undecided segments, in order, between the states that the chain names."""
        now, held = None, []

        def made() -> pa.RecordBatch:
            part, seg, enter, leave = now
            return _batch(list(_fragments(held, viterbi(model, np.concatenate([p[3] for p in held]), enter, leave), part, seg)))

        for b in batches:
            for conv, order, seq, part, seg, codes, lines, enter, leave in zip(*(b.column(c).to_pylist() for c in ("conv", "ord", "seq", "part", "seg", "codes", "lines", "enter", "leave"))):
                if held and (part, seg) != now[:2]:
                    yield made()
                    held = []
                now = (part, seg, enter, leave)
                held.append((conv, order, seq, np.array(codes), lines))
        if held:
            yield made()

    return run


def parse(pieces: DataFrame, model: Model, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Fragments of turns: conv (as text), ord, seq, line, role, starts, text (without markers), rendered, part, seg; stored.

    A row of pieces is one or more lines of a transcript; the pieces of a conversation follow one another by order_col (null
    first), then by a hash of the text, then as they stand in the table. A fragment is what one turn has of one piece: line is
    its first line there, and starts says whether the turn begins with it. The rendered fragments of a conversation,
    one after another by (ord, seq, line), are its canonical form. Null or empty text is one blank line; a null
    conversation is one of its own; repeated rows follow one another. An empty table gives no rows. Other columns of pieces
    are ignored, whatever their names. part and seg number the tasks' stretches of conversations in order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = pieces.select(F.col(conv_col).cast("string").alias("conv"), F.col(order_col).cast("long").alias("ord"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("seq"), text.alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("ord").asc_nulls_first(), "hash", "seq"]
    ranged = thin.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash")
    first = store(ranged.mapInArrow(_parse(model), ROW), "chat-parsed")
    ends = first.where("scores is not null").groupBy("conv").applyInPandas(lambda s: _ends(s), "part int, seg int, enter int, leave int")
    ends = store(ends.withColumnsRenamed({"part": "p", "seg": "s"}), "chat-ends")
    rest = first.where("codes is not null").join(small(ends, ends.count(), MAX_BROADCAST_ENDS), (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s")))
    rest = rest.repartition("part", "seg").sortWithinPartitions("part", "seg", "line")
    decided = first.where("role is not null").unionByName(rest.mapInArrow(_decode(model), ROW))
    header = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    rendered = F.concat(F.when(F.col("starts"), header).otherwise(""), F.col("text"), F.lit("\n"))
    return store(decided.select("conv", "ord", "seq", "line", "role", "starts", "text", rendered.alias("rendered"), "part", "seg"), "chat-fragments")


def turns(fragments: DataFrame) -> DataFrame:
    """One row a turn of parse()'s fragments: conv, ord, seq, line (where it begins), role, text, rendered.

    A fragment that goes on belongs to the last one before it that starts: in its own stretch, or, at a stretch's begin, in
    the last stretch of the conversation that has a start; so windows run over stretches, which are a task's at most.
    """
    at = F.struct("ord", "seq", "line")
    own = Window.partitionBy("part", "seg").orderBy(F.col("ord").asc_nulls_first(), "seq", "line").rowsBetween(Window.unboundedPreceding, 0)
    f = fragments.withColumn("begin", F.last(F.when(F.col("starts"), at), ignorenulls=True).over(own))
    stretch = fragments.groupBy("conv", "part", "seg").agg(F.max_by(F.when(F.col("starts"), at), F.when(F.col("starts"), F.struct(F.coalesce("ord", F.lit(-(1 << 62))), "seq", "line"))).alias("last"))
    earlier = Window.partitionBy("conv").orderBy("part", "seg").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.select(F.col("part").alias("p"), F.col("seg").alias("s"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    on = F.col("begin").isNull() & (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s"))
    open_ = f.where("begin is null").join(stretch, on).withColumn("begin", F.col("before")).select(f.columns)
    f = f.where("begin is not null").unionByName(open_)
    piece = F.struct(F.coalesce("ord", F.lit(-(1 << 62))).alias("o"), "seq", "line", "text")
    t = f.groupBy("conv", "begin").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.first("role").alias("role"))
    text = F.array_join(F.transform("pieces", lambda x: x["text"]), "\n")
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n"))
    return t.select("conv", "begin.ord", "begin.seq", "begin.line", "role", text.alias("text"), rendered.alias("rendered"))


def train(given: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", max_turns: int = MAX_TURNS) -> Model:
    """The model of whole conversations with known roles, of max_turns turns at most: those of the least hashes.

    Null texts are empty; without a turn of a known role all tables are even.
    """
    role = F.lower(F.btrim(F.col(role_col)))
    one = given.select(F.xxhash64(F.col(conv_col)).alias("conv"), F.col(order_col).cast("long").alias("ord"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = store(one.orderBy("conv", F.col("ord").asc_nulls_first(), "role", "text").limit(max_turns), "chat-sample")
    by: dict[int, list] = {}
    for r in some.orderBy("conv", F.col("ord").asc_nulls_first(), "role", "text").toLocalIterator():
        by.setdefault(r["conv"], []).append((r["role"], r["text"]))
    whole = list(by.values())
    return fit(whole)


#: How transcripts write their speakers: (system, user, assistant), by style; the last has no markers at all.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("### System:\n", "### Instruction:\n", "### Response:\n"),
    ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n"),
    ("[system] ", "Q: ", "A: "),
    ("- ", "- ", "- "),
    ("", "", ""),
)


def transcripts(turns: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with their text as a raw transcript has it: after a marker, in a style that goes with the conversation.

    One style has bare dashes, the last none at all; a null or unknown role gets a dash in any other style.
    """
    style = F.pmod(F.xxhash64(conv_col), F.lit(len(STYLES)))
    role = F.lower(F.btrim(F.col(role_col)))
    mark = F.when(style == len(STYLES) - 1, "").otherwise("- ")
    for r, name in enumerate(ROLES):
        mark = F.when(role == name, F.get(F.array(*[F.lit(s[r]) for s in STYLES]), style.cast("int"))).otherwise(mark)
    return turns.withColumn(text_col, F.concat(mark, F.coalesce(F.col(text_col), F.lit(""))))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, written as raw transcripts and parsed back by a model of MAX_TURNS turns with known roles."""
    given = table(spark, sf_dir, "conversations")
    out = turns(parse(transcripts(given), train(given)))
    return out.select(F.col("conv").cast("long").alias("conv_id"), F.col("ord").alias("turn"), "line", "role", "text", "rendered")


QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES: dict[str, str] = {}
