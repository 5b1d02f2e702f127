"""Live position in a book: a session first discovers the verse that is read, then follows it word by word.

`step` takes a session's state and a chunk of sound to the next state and the messages that come of it. It is a plain
function; `track` hosts it over a table of sessions, `track_stream` over a stream. What turns sound into text is given.

Rows of a session are taken in the order of `seq`; a row that is no later than one already taken is late and dropped.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scansio.functions import score as sc
from scansio.functions.pytext import normalized
from scansio.operators.passages import MOST_VERSES, Answer, PassageIndex, Verse

# Samples: of a cycle and of the longest window when discovering and when following; of silence that ends following.
SEEK_CYCLE, SEEK_WINDOW, FOLLOW_CYCLE, FOLLOW_WINDOW, SILENCE_END = 32_000, 160_000, 8_000, 80_000, 32_000
SILENCE_RMS = 0.005
# Least scores: of a first and of later matches, of a jump away soon after a match, of any answer.
FIRST, LATER, AWAY, ANSWER = 0.75, 0.45, 0.65, 0.25
STALE_LIMIT = 4
#: Turns a window of samples, and the text that came with the last chunk if any, into a transcript.
Transcribe = Callable[[np.ndarray, str | None], str]

MESSAGE = "session_id long, seq long, n int, type string, surah int, ayah int, confidence double, word_index int, total_words int, matched_indices array<int>, text string, candidates array<struct<surah:int,ayah:int,score:double>>, surrounding array<struct<surah:int,ayah:int,text:string,is_current:boolean>>"


@dataclass
class State:
    sound: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    fresh: int = 0
    last: tuple[int, int] | None = None
    last_text: str = ""
    before: tuple[int, int] | None = None
    before_text: str = ""
    matched: bool = False
    since: int | None = None  # cycles since a match; None before any
    verse: tuple[int, int] | None = None
    word: int = -1
    quiet: int = 0
    stale: int = 0
    cooldown: int = 0
    grace: int = 0
    heard: str = ""
    heard_cycles: int = 0
    deferred: tuple[int, int] | None = None
    deferrals: int = 0
    seq: int = -1

    def forget(self) -> None:
        """As before the first chunk, but for what tells late rows."""
        self.__dict__.update(State(seq=self.seq).__dict__)

    def dump(self) -> str:
        return json.dumps(asdict(self) | {"sound": base64.b64encode(self.sound.tobytes()).decode()})

    @staticmethod
    def load(text: str) -> State:
        pairs = {k: tuple(v) if k in ("last", "before", "verse", "deferred") and v is not None else v for k, v in json.loads(text).items()}
        return State(**pairs | {"sound": np.frombuffer(base64.b64decode(pairs["sound"]), np.float32)})


def two_digits(x: float) -> float:
    return int(x * 100 + 0.5) / 100


def joined_text(so_far: str, new: str, cycles: int) -> tuple[str, int]:
    """What was heard so far with what is heard now: overlapping where the end of one is like the start of the other (6
    words at most, 2 at least); else one after the other, for four cycles; then anew."""
    if not so_far:
        return new, cycles
    a, b = so_far.split(" "), new.split(" ")
    for n in range(min(len(a), len(b), 6), 1, -1):
        if sc.partial_ratio_of(" ".join(a[-n:]), " ".join(b[:n])) >= 0.7:
            return f"{so_far} {' '.join(b[n:])}", cycles
    return (f"{so_far} {new}", cycles) if cycles <= 4 else (new, 1)


class Tracker:
    def __init__(self, index: PassageIndex, transcribe: Transcribe):
        self.index, self.transcribe = index, transcribe

    # Each rule below reads and writes the state, and returns messages as dicts.

    def step(self, s: State, samples: np.ndarray, text: str | None = None) -> list[dict]:
        s.sound = np.concatenate([s.sound, samples])[-(FOLLOW_WINDOW if s.verse else SEEK_WINDOW) :]
        s.fresh += len(samples)
        return self._follow(s, samples, text) if s.verse else self._seek(s, text)

    def _hear(self, s: State, text: str | None) -> str:
        return normalized(self.transcribe(s.sound, text))

    def _enter(self, s: State, ref: tuple[int, int]) -> None:
        s.verse, s.word, s.quiet, s.stale, s.heard, s.heard_cycles, s.grace = ref, -1, 0, 0, "", 0, 2

    def _leave(self, s: State, why: str) -> None:
        """Why: 'complete', 'jump', 'stale' or 'silence'. A verse left stale before its half was wrong: the match before
        it counts again. Left stale later, what was read of it is the text to tell from what follows."""
        words = self.index.verses[self.index.at[s.verse]].words
        if why == "complete":
            s.matched = True
        elif why == "stale" and (s.word + 1) / len(words) < 0.5:
            s.last, s.last_text, s.cooldown = s.before, s.before_text, 0
        elif why == "stale" and s.word >= 0:
            s.matched, s.last_text = True, " ".join(words[: s.word + 1])
        elif why == "silence":
            s.cooldown = 0
        s.verse, s.word, s.quiet, s.stale, s.heard, s.heard_cycles = None, -1, 0, 0, "", 0

    def _matched(self, s: State, ref: tuple[int, int], score: float, text: str, to: tuple[int, int] | None = None) -> dict:
        """The message of a match; the state remembers it and the one before."""
        s.before, s.before_text, s.last, s.last_text = s.last, s.last_text, to or ref, text
        i = self.index.at.get(ref)
        around = [dict(zip(("surah", "ayah", "text", "is_current"), x)) for x in self.index.around(*ref)]
        return {"type": "verse_match", "surah": ref[0], "ayah": ref[1], "confidence": score, "text": self.index.verses[i].text if i is not None else text, "surrounding": around}

    def _seek(self, s: State, text: str | None) -> list[dict]:
        if s.fresh < SEEK_CYCLE:
            return []
        s.fresh = 0
        s.since = None if s.since is None else s.since + 1
        end = s.sound[-SEEK_CYCLE:].astype(np.float64)
        if np.sqrt(np.mean(end * end)) < SILENCE_RMS:
            s.heard, s.heard_cycles = "", 0
            return []
        now = self._hear(s, text)
        if len(now) < 5 or (s.last_text and sc.partial_ratio_of(now, s.last_text) > 0.7):
            return []
        s.heard, s.heard_cycles = joined_text(s.heard, now, s.heard_cycles + 1)
        asked = s.heard if len(s.heard) > len(now) * 1.3 else now
        soon = s.last is not None and s.since is not None and s.since <= 3
        found = self.index.narrow(asked, s.last, 5, ANSWER) if soon else self.index.match(asked, ANSWER, 4, s.last, 10)
        out = []
        if found and (near := [r for r in found.runners if r[2] >= 0.15][:10]):
            out.append({"type": "candidate_list", "text": now, "candidates": [dict(zip(("surah", "ayah", "score"), r)) for r in near]})
        if not found or found.score < self._least(s, found):
            return [*out, {"type": "raw_transcript", "text": now, "confidence": two_digits(found.score) if found else 0.0}]
        if self._ambiguous(s, found, now):
            return [*out, {"type": "raw_transcript", "text": now, "confidence": two_digits(found.score)}]
        ref = (found.surah, found.ayah)
        if ref == s.last:
            return out
        # A run of verses is followed from its first verse, but what comes next is told from its last.
        out.append(self._matched(s, ref, two_digits(found.score), found.norm, (found.surah, found.ayah_end) if found.ayah_end else None))
        s.matched, s.since, s.deferred, s.deferrals = True, 0, None, 0
        self._enter(s, ref)
        return out

    def _least(self, s: State, found: Answer) -> float:
        least = LATER if s.matched else FIRST
        if s.matched and s.last and s.since is not None and s.since <= 2:
            goes_on = found.surah == s.last[0] and 1 <= found.ayah - s.last[1] <= 3
            return least if goes_on else max(least, AWAY)
        return least

    def _ambiguous(self, s: State, found: Answer, now: str) -> bool:
        """Whether a match waits, as another verse scores nearly the same, begins with the same words, and hardly more
        than these were heard. It waits twice in a row at most."""
        ref = (found.surah, found.ayah)
        other = next((r for r in found.runners if (r[0], r[1]) != ref), None) if len(found.runners) >= 2 else None
        if other is None or other[2] < found.runners[0][2] * 0.97:
            return False
        a, b = (self.index.verses[self.index.at[r]].norm.split(" ") for r in (ref, (other[0], other[1])))
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        n = now.count(" ") + 1
        if shared < (4 if n <= 6 else 8) or n > shared + 2 or found.score >= 0.98:
            return False
        s.deferrals, s.deferred = (s.deferrals + 1 if s.deferred == ref else 1), ref
        if s.deferrals <= 2:
            return True
        s.deferrals, s.deferred = 0, None
        return False

    def _follow(self, s: State, samples: np.ndarray, text: str | None) -> list[dict]:
        if len(samples) and np.sqrt(np.mean(samples.astype(np.float64) ** 2)) < SILENCE_RMS:
            s.quiet += len(samples)
            if s.quiet >= SILENCE_END:
                self._leave(s, "silence")
                s.fresh = 0
                return []
        else:
            s.quiet = 0
        if s.fresh < FOLLOW_CYCLE:
            return []
        s.fresh = 0
        s.cooldown = max(0, s.cooldown - 1)
        if s.grace > 0:
            s.grace -= 1
            return []
        now = self._hear(s, text)
        if len(now) < 3:
            return []
        verse = self.index.verses[self.index.at[s.verse]]
        places = sc.align_of(now.split(" "), verse.words, max(s.word, 0))
        if not places and len(now) >= 5 and len(verse.words) >= 10:
            w = sc.char_progress_of(now, verse.norm, verse.words)
            places = [w] if w > s.word else []
        if not places or places[-1] <= s.word:
            s.stale += 1
            jumped = self._jump(s, now) if s.stale >= 2 and len(now) >= 8 else []
            if jumped:
                return jumped
            if s.stale >= STALE_LIMIT:
                self._leave(s, "stale")
                s.fresh = 0
                return []
            out = []
        else:
            s.stale, s.word = 0, places[-1]
            out = [{"type": "word_progress", "surah": verse.surah, "ayah": verse.ayah, "word_index": s.word + 1, "total_words": len(verse.words), "matched_indices": places}]
        if places and (s.word + 1) / len(verse.words) >= 0.8 and s.word >= len(verse.words) - 2:
            out += self._completed(s)
        return out

    def _jump(self, s: State, now: str) -> list[dict]:
        """Another verse nearby that is read instead; soon after a verse was completed it must be surer, and not be one
        before in the surah."""
        ref = s.verse
        found = self.index.narrow(now, ref, 3, 0.7 if s.cooldown else 0.5)
        to = (found.surah, found.ayah) if found else ref
        if to == ref or (s.cooldown and to[0] == ref[0] and to[1] < ref[1]):
            return []
        s.last, s.last_text = ref, self.index.verses[self.index.at[ref]].norm
        self._leave(s, "jump")
        message = self._matched(s, to, two_digits(found.score), self.index.verses[self.index.at[to]].norm)
        s.matched, s.since = True, 0
        self._enter(s, to)
        s.sound = s.sound[-SEEK_CYCLE:]
        return [message]

    def _completed(self, s: State) -> list[dict]:
        ref = s.verse
        s.last, s.last_text, s.since = ref, self.index.verses[self.index.at[ref]].norm, 0
        i = self.index.next_of(*ref)
        self._leave(s, "complete")
        out = []
        if i is not None:
            v = self.index.verses[i]
            out.append(self._matched(s, (v.surah, v.ayah), 0.99, v.norm))
            self._enter(s, (v.surah, v.ayah))
            s.cooldown = 3
        s.sound, s.heard, s.heard_cycles = s.sound[:0], "", 0
        return out


COLUMNS = ["session_id", "seq", "n", "type", "surah", "ayah", "confidence", "word_index", "total_words", "matched_indices", "text", "candidates", "surrounding"]


def _rows(tracker: Tracker, s: State, session: int, chunks: Iterator[tuple]) -> list[dict]:
    out = []
    for seq, samples, text, *reset in chunks:
        if seq <= s.seq:
            continue
        s.seq = seq
        if reset and reset[0] is not None and bool(reset[0]):
            s.forget()
            continue
        for n, message in enumerate(tracker.step(s, np.asarray(samples, np.float32), text)):
            out.append({"session_id": session, "seq": seq, "n": n, **message})
    return out


def _frame(rows: list[dict]) -> pd.DataFrame:
    whole = ("surah", "ayah", "word_index", "total_words")
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int32" if c in whole else object) for c in COLUMNS})


def last_text(_: np.ndarray, text: str | None) -> str:
    """A transcriber for chunks that bring their text."""
    return text or ""


def track(chunks: DataFrame, index: PassageIndex, transcribe: Transcribe = last_text) -> DataFrame:
    """The messages of sessions `session_id, seq, samples, text` (or `n_samples, level` for samples), in MESSAGE's columns. A
    chunk with a true `reset`, where there is such a column, makes its session begin anew and brings no sound. A session's
    rows pass in order through one task, batch by batch; only its state is held, never its rows."""
    shared = chunks.sparkSession.sparkContext.broadcast(index)  # at most MOST_VERSES verses

    sounds = ["samples"] if "samples" in chunks.columns else ["n_samples", "level"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, s, session = Tracker(shared.value, transcribe), State(), None
        for pdf in batches:
            rows = []
            for own, part in pdf.groupby("session_id", sort=False):
                if own != session:
                    s, session = State(), own
                rows += _rows(tracker, s, own, _chunks(part))
            yield _frame(rows)

    resets = [c for c in ("reset",) if c in chunks.columns]
    ordered = chunks.select("session_id", "seq", *sounds, "text", *resets).where("session_id IS NOT NULL AND seq IS NOT NULL")
    # The work is in Python, which the sizes of partitions don't tell: their number is fixed, so that none are merged.
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.sparkSession.sparkContext.defaultParallelism)
    return ordered.repartition(parts, "session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, MESSAGE)


def _chunks(part: pd.DataFrame) -> Iterator[tuple]:
    """`seq, samples, text` of chunks, and `reset` where it is given."""
    return zip(part["seq"], _sounds(part), part["text"], *[part[c] for c in ("reset",) if c in part])


def _sounds(part: pd.DataFrame) -> Iterator[np.ndarray]:
    """The samples of chunks, or even ones of a level where only that and their number are given."""
    if "samples" in part:
        return iter(part["samples"])
    return (np.full(int(n), level, np.float32) for n, level in zip(part["n_samples"], part["level"]))


#: Parts of a book's sessions, each with its own copy of the book.
SPLIT = 16
VERSE = ["surah", "ayah", "text_uthmani", "surah_name", "norm", "ns", "no_bsm", "no_bsm_ns", "words"]


def track_books(chunks: DataFrame, corpus: DataFrame, transcribe: Transcribe = last_text) -> DataFrame:
    """`track` of every session in every book: MESSAGE's columns after `book`. No book is left out beforehand, so the work
    is sessions times books. The verses of a book come before the chunks of
    its sessions in the same task, which holds one book's index and one session's state at a time."""
    sounds = ["samples"] if "samples" in chunks.columns else ["n_samples", "level"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, verses, tracker, s, session = None, [], None, State(), None
        for pdf in batches:
            frames = []
            for (own, at, is_chunk, who), part in pdf.groupby(["book", "part", "is_chunk", "session_id"], sort=False, dropna=False):
                if (own, at) != book:
                    book, verses, tracker, session = (own, at), [], None, None
                if not is_chunk:
                    verses += [Verse(v["surah"], v["ayah"], v["text_uthmani"] or "", v["surah_name"] or "", v["norm"], v["ns"], v["no_bsm"], v["no_bsm_ns"], list(v["words"])) for v in part["verse"]]
                    if len(verses) > MOST_VERSES:
                        raise ValueError(f"{own}: an index holds {MOST_VERSES} verses at most")
                    continue
                if tracker is None:
                    tracker = Tracker(PassageIndex(verses), transcribe)
                if who != session:
                    s, session = State(), who
                got = _frame(_rows(tracker, s, int(who), _chunks(part.assign(seq=part["seq"].astype("int64")))))
                got.insert(0, "book", own)
                frames.append(got)
            if frames:
                yield pd.concat(frames)

    sounds += [c for c in ("reset",) if c in chunks.columns]
    heard = chunks.select("session_id", "seq", *sounds, "text").where("session_id IS NOT NULL AND seq IS NOT NULL")
    part = F.pmod(F.xxhash64("session_id"), F.lit(SPLIT)).cast("int")
    asked = heard.crossJoin(F.broadcast(corpus.select("book").distinct())).select("book", part.alias("part"), F.lit(True).alias("is_chunk"), "session_id", "seq", *sounds, "text")
    # Verses come first, in the order of their own place in the book.
    read = corpus.select("book", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("part"), F.lit(False).alias("is_chunk"), F.col("idx").cast("long").alias("seq"), F.struct(*VERSE).alias("verse"))
    # As many partitions as `track` has: the work is in Python, which sizes don't tell.
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.sparkSession.sparkContext.defaultParallelism)
    both = read.unionByName(asked, allowMissingColumns=True).repartition(parts, "book", "part").sortWithinPartitions("book", "part", "is_chunk", "session_id", "seq")
    return both.mapInPandas(run, f"book string, {MESSAGE}")


def track_stream(chunks: DataFrame, index: PassageIndex, transcribe: Transcribe = last_text, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream: state is kept by session, each micro-batch is taken in the order of `seq`.

    With `idle_ms` a session of which nothing comes for so long is over and its state is removed; what comes later begins
    anew. A stream that runs on should have it, or its state grows with every session; one that ends with its input
    (`availableNow`) must not, as Spark then goes on to wait for sessions to end."""
    shared = chunks.sparkSession.sparkContext.broadcast(index)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield _frame([])
            return
        s = State.load(state.get[0]) if state.exists else State()
        rows = sorted((r for pdf in batches for r in _chunks(pdf)), key=lambda r: r[0])
        out = _rows(Tracker(shared.value, transcribe), s, key[0], iter(rows))
        state.update((s.dump(),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield _frame(out)

    return chunks.groupBy("session_id").applyInPandasWithState(run, MESSAGE, "state string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
