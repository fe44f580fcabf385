"""Mapping of free-entered values to a canonical list.

1. Values and all canonical names and aliases are folded (case, accents, punctuation, spacing).
2. A multi-pattern automaton finds every name or alias that stands as whole words in the value;
   of overlapping mentions the longest wins, and of several the one that covers most.
3. Values without a mention lose what `noise` matches at their ends and go to similarity: the edit distance (with swaps) of the letters without
   blanks, else the token-set similarity, in which each token of the alias looks for its closest
   token of the value. Below the thresholds the value is unmatched (-1).

Scale: narrow, no shuffle; within a task each distinct value is matched once. The canonical list is
a dimension table; more than `max_names` names is an error rather than a silent broadcast.

Defined results
- null and blank values: id null, how 'empty'. Values that mean nothing listed: -1, how 'none'.
- a value equal to a canonical name letter for letter: how 'exact'.
- ties: the longer alias, then the smaller id. Very long values are matched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.llm.edits import edits
from planloom.llm.textfold import fold

# Ways in which the states of work are written in English, German, French, Spanish and Vietnamese.
STATUS_ALIASES: dict[str, tuple[str, ...]] = {
    "Not Started": (
        "not yet begun", "not begun", "unstarted", "to do", "todo", "backlog", "yet to start", "not yet started", "0%", "nicht begonnen",
        "noch nicht begonnen", "nicht gestartet", "pas commencé", "non commencé", "à faire", "sin empezar", "no iniciado", "por hacer", "chưa bắt đầu", "chưa làm",
    ),
    "In Progress": (
        "inprogress", "wip", "work in progress", "ongoing", "underway", "under way", "doing", "being worked on", "working on it", "halfway through", "in prog.",
        "in Arbeit", "in Bearbeitung", "läuft", "en cours", "en curso", "en progreso", "đang làm", "đang thực hiện", "đang tiến hành",
    ),
    "Completed": (
        "complete", "compl.", "done", "all done", "finished", "wrapped up", "100%", "fertig", "erledigt", "abgeschlossen", "terminé", "fini", "achevé",
        "terminado", "completado", "hecho", "xong", "hoàn tất", "hoàn thành", "đã xong",
    ),
    "Blocked": ("blkd", "blocker", "stuck", "impeded", "can't proceed", "cannot proceed", "blockiert", "bloqué", "bloqueado", "bị chặn"),
    "On Hold": ("onhold", "paused", "on ice", "halted for now", "suspended", "pausiert", "angehalten", "en pause", "en attente", "en pausa", "en espera", "tạm dừng"),
    "In Review": (
        "in rev.", "under review", "reviewing", "peer review", "code review", "in Prüfung", "wird geprüft", "en relecture", "en révision", "en revisión",
        "đang xem xét", "đang duyệt",
    ),
    "Ready for Testing": (
        "ready to test", "ready 4 testing", "ready for qa", "ready for test", "rdy for test", "testable", "bereit zum Test", "testbereit", "prêt à tester",
        "prêt pour test", "listo para pruebas", "listo para probar", "sẵn sàng kiểm thử",
    ),
    "Cancelled": (
        "canceled", "cxl", "called off", "abandoned", "scrapped", "won't do", "abgebrochen", "storniert", "abgesagt", "annulé", "abandonné", "cancelado", "anulado", "đã hủy", "hủy bỏ",
    ),
    "Reopened": ("re-opened", "re-open", "reopen", "opened again", "back open", "wieder geöffnet", "wiedereröffnet", "rouvert", "réouvert", "reabierto", "mở lại"),
    "Awaiting Approval": (
        "pending approval", "needs approval", "waiting for approval", "waiting for sign-off", "awaiting sign off", "await. appr.", "wartet auf Freigabe",
        "en attente d'approbation", "pendiente de aprobación", "esperando aprobación", "chờ duyệt", "chờ phê duyệt",
    ),
    "Deferred": (
        "postponed", "put off", "moved to later", "pushed to next quarter", "pushed back", "verschoben", "aufgeschoben", "vertagt", "reporté", "différé", "aplazado", "pospuesto", "dời lại", "hoãn lại",
    ),
    "Deployed": (
        "live", "went live", "released", "rolled out", "shipped", "in production", "in prod", "ausgerollt", "veröffentlicht", "déployé", "mis en production",
        "desplegado", "en producción", "đã triển khai",
    ),
}
# What people add around a status; it says nothing about the status itself.
STATUS_NOISE = re.compile(
    r"\([^()]*\)\s*$|@\s*\d[\d/.\-]*\s*$|^\s*status\s*[:=]|^\s*now\s|\bsince\s+\w+\s*$|\bpls\.? check\b|\bplease check\b|\bsee (?:notes?|ticket)\b|\d{1,2}[./]\d{1,2}[./]?\s*$",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"\d+%|[^\W_]+")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789%"


def normal(value: str) -> str:
    """Folded tokens joined by single blanks; a percentage stays one token."""
    return " ".join(_TOKEN.findall(fold(value)))


def _limit(n: int) -> int:
    return 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 6 else 3


class Matcher:
    """Finds the canonical id of a value."""

    def __init__(self, names: list[tuple[int, str]], aliases: dict[str, tuple[str, ...]], threshold: float, noise: re.Pattern[str] | None = None) -> None:
        self.exact = {n: i for i, n in sorted(names, reverse=True)}
        self.threshold, self.noise = threshold, noise
        forms: dict[str, int] = {}
        for i, n in sorted(names):
            for a in (n, *aliases.get(n, ())):
                if normal(a):
                    forms.setdefault(normal(a), i)
        self.forms = sorted(forms.items(), key=lambda x: (-len(x[0]), x[1], x[0]))
        self.automaton = ahocorasick.Automaton()
        for f, i in self.forms:
            self.automaton.add_word(f" {f} ", (f, i))
            if " " in f and len(f) >= 6:
                self.automaton.add_word(f" {f.replace(' ', '')} ", (f, i))
        if self.forms:
            self.automaton.make_automaton()
        self.packed = [f.replace(" ", "") for f, _ in self.forms]
        self.bags = np.array([_bag(p) for p in self.packed]) if self.forms else np.zeros((0, len(_ALPHABET)), dtype=np.int16)
        self.limits = np.array([_limit(len(p)) for p in self.packed])

    def mention(self, text: str) -> int | None:
        """The id of the mention that covers most of the text."""
        found = sorted(((end - len(f) - 1, end, i) for end, (f, i) in self.automaton.iter(f" {text} ")), key=lambda x: (x[0] - x[1], x[0], x[2]))
        taken: list[tuple[int, int, int]] = []
        for a, b, i in found:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, i))
        if not taken:
            return None
        cover: dict[int, int] = {}
        for a, b, i in taken:
            cover[i] = cover.get(i, 0) + b - a
        return min(cover, key=lambda i: (-cover[i], i))

    def similar(self, text: str) -> tuple[float, int]:
        """The best similarity and its id."""
        best = (0.0, 0, -1)
        packed = text.replace(" ", "")
        near = np.flatnonzero(np.abs(self.bags - _bag(packed)).max(axis=1, initial=0) <= 3)
        if len(near):
            diff = self.bags[near] - _bag(packed)
            apart = np.maximum(np.clip(diff, 0, None).sum(axis=1), np.clip(-diff, 0, None).sum(axis=1))
            for k in near[apart <= self.limits[near]].tolist():
                p = self.packed[k]
                d = edits(p, packed, int(self.limits[k]))
                if d <= self.limits[k]:
                    best = max(best, (1 - d / max(len(p), len(packed)), len(p), -self.forms[k][1] - 1))
        if best[0] < self.threshold:
            tokens = text.split(" ")
            for k, (f, i) in enumerate(self.forms):
                s = _token_set(f.split(" "), tokens) if len(self.packed[k]) >= 6 else 0.0
                if s >= self.threshold:
                    best = max(best, (s, len(f), -i - 1))
        return best[0], -best[2] - 1

    def match(self, value: str | None) -> tuple[int | None, str, float]:
        """(id, how, score) of one value."""
        if value is None or not value.strip():
            return None, "empty", 0.0
        if value in self.exact:
            return self.exact[value], "exact", 1.0
        text = normal(value)
        if not self.forms or not text:
            return -1, "none", 0.0
        i = self.mention(text)
        if i is not None:
            return i, "mention", 1.0
        core = value
        while self.noise is not None and (shorter := self.noise.sub(" ", core).strip()) != core.strip() and shorter:
            core = shorter
        text = normal(core) or text
        score, i = self.similar(text)
        return (i, "similar", score) if score >= self.threshold else (-1, "none", score)


def _bag(s: str) -> np.ndarray:
    v = np.zeros(len(_ALPHABET), dtype=np.int16)
    for c in s:
        k = _ALPHABET.find(c)
        if k >= 0:
            v[k] += 1
    return v


def _token_set(alias: list[str], tokens: list[str]) -> float:
    """Share of the alias's letters whose tokens are found, less a quarter of what is left over in the value."""
    left = list(tokens)
    total = found = 0.0
    for a in alias:
        total += len(a)
        best, at = 0.0, -1
        for k, t in enumerate(left):
            limit = 0 if len(a) <= 3 else 1 if len(a) <= 6 else 2
            d = edits(a, t, limit)
            if d <= limit and 1 - d / len(a) > best:
                best, at = 1 - d / len(a), k
        if at < 0:
            return 0.0
        found += best * len(a)
        left.pop(at)
    return found / (total + 0.25 * sum(map(len, left)))


def match_canonical(
    df: DataFrame, column: str, names: DataFrame, id_column: str, name_column: str, keep: list[str],
    aliases: dict[str, tuple[str, ...]], noise: re.Pattern[str] | None = None, threshold: float = 0.57, max_names: int = 10_000,
) -> DataFrame:
    """The `keep` columns with canonical_id, how and score for each row of df.

    aliases lists other spellings of canonical names; noise matches what people add around a value."""
    rows = names.where(F.col(name_column).isNotNull()).select(F.col(id_column).alias("i"), F.col(name_column).alias("n")).limit(max_names + 1).collect()
    if len(rows) > max_names:
        raise ValueError(f"more than {max_names} canonical names")
    listed = [(r.i, r.n) for r in rows]
    src = df.select(*keep, F.col(column).alias("__value"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("canonical_id", T.IntegerType()), T.StructField("how", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(listed, aliases, threshold, noise)
        known: dict[str | None, tuple[int | None, str, float]] = {}
        for b in batches:
            if len(known) > 200_000:  # memory of a long task; results don't depend on it
                known.clear()
            values = b["__value"].tolist()
            for v in set(values):
                if v not in known:
                    known[v] = m.match(v)
            out = b[keep].copy()
            out["canonical_id"] = pd.array([known[v][0] for v in values], dtype="Int32")
            out["how"] = [known[v][1] for v in values]
            out["score"] = [known[v][2] for v in values]
            yield out

    return src.mapInPandas(run, schema)
