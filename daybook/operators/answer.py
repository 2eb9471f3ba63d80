"""Questions: routing without a model, the choice of context, and a cited answer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from ..functions import periods, text
from . import filters, search, stats

#: Characters of context that a fast answer and a precise one may take, days under which no digests serve and up to
#: which weeks do, what a message takes in tokens.
FAST, PRECISE = 16_000, 96_000
NO_DIGEST_DAYS, WEEK_DIGEST_DAYS, MONTH_DIGEST_DAYS = 10, 62, 430
CHARS_A_TOKEN, TOKENS_A_MESSAGE = 3, 8


@dataclass
class Plan:
    """A routed question. A reversed range is swapped."""

    intent: str = "narrative"
    since: date | None = None
    until: date | None = None
    names: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    needs_raw: bool = False

    def __post_init__(self):
        if self.since and self.until and self.since > self.until:
            self.since, self.until = self.until, self.since


def route(question: str, today: date) -> Plan:
    """By rules: counting words ask for an aggregate, a named day or year bounds the range."""
    low = question.lower()
    intent = "aggregate" if re.search(r"\b(how often|how many|average|trend|most|mood over|per month)\b", low) else "narrative"
    plan = Plan(intent, needs_raw=bool(re.search(r"\b(exactly|quote|what did i (say|write))\b", low)))
    if day := periods.explicit_day(question, today):
        plan.since = plan.until = day
    elif m := re.search(r"\b(19|20)\d\d(?:-(?:\d\d?|[wW]\d\d?))?\b", question):
        try:
            plan.since, plan.until = periods.bounds(*periods.parse(m[0]))
        except ValueError:
            pass
    plan.keywords = [w for w in dict.fromkeys(re.findall(r"[^\W_][\w'-]{2,}", low)) if w not in text.STOP_WORDS][:8]
    return plan


def fit(blocks: list[str], budget: int) -> list[str]:
    """Whole blocks by priority, while they fit; what doesn't fit is skipped and takes nothing."""
    kept = []
    for block in blocks:
        if len(block) <= budget:
            kept.append(block)
            budget -= len(block)
    return kept


def digest_kind(since: date | None, until: date | None) -> str | None:
    """Which digests give background: none under ten days, weeks up to 62, else months, years beyond 14 months."""
    if since is None or until is None:
        return "month"
    days = (until - since).days + 1
    return None if days < NO_DIGEST_DAYS else "week" if days <= WEEK_DIGEST_DAYS else "month" if days <= MONTH_DIGEST_DAYS else "year"


def tokens(messages: list[str]) -> int:
    return sum(len(m) // CHARS_A_TOKEN + TOKENS_A_MESSAGE for m in messages)


def window(messages: list[str], least: int = 2048, reply: int = 1024) -> int:
    size = least
    while size < tokens(messages) + reply:
        size *= 2
    return size


def aggregate_facts(plan: Plan, entries: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """What an aggregate answer is told: mood by month, top tags, bounds."""
    rows = filters.in_range(entries, plan.since, plan.until)
    return {"mood": stats.monthly_mood(rows), "tags": stats.top_tags(rows, tags, 10), "bounds": stats.date_bounds(rows)}


def retrieve(plan: Plan, entries: DataFrame, most: int = 8) -> DataFrame:
    """The entries (entry_id, entry_date, text) that answer best: by keywords, else the newest. A named day is always in, first."""
    rows = filters.in_range(entries, plan.since, plan.until)
    newest = rows.orderBy(F.desc("entry_date"), F.desc("entry_id")).limit(most)
    if not plan.keywords or plan.since is not None and plan.since == plan.until:
        return newest
    spark = entries.sparkSession
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, plan.keywords))).alias("term"))
    docs = entries.select(F.col("entry_id").alias("doc_id"), "text")
    found = search.bm25(docs, asked, most, rows.select(F.col("entry_id").alias("doc_id"))).select(F.col("doc_id").alias("entry_id"), "rank")
    if found.isEmpty():
        return newest
    return rows.join(F.broadcast(found), "entry_id").orderBy("rank")


def with_day(found: DataFrame, entries: DataFrame, day: date | None) -> DataFrame:
    """Retrieved entries with the ones of an explicitly named day before them, each once."""
    if day is None:
        return found
    own = entries.where(F.col("entry_date") == F.lit(day))
    return own.unionByName(found.join(own.select("entry_id"), "entry_id", "left_anti"), allowMissingColumns=True)


def cited(answer: str, days: list[date]) -> list[date]:
    """The days among those read that an answer names."""
    named = set()
    for m in re.finditer(r"\b(\d{4}-\d\d-\d\d)\b", answer):
        try:
            named.add(date.fromisoformat(m[1]))
        except ValueError:
            continue
    return sorted(named & set(days))


_TAG = re.compile(r"<(/?)think>", re.I)
#: The longest beginning of a tag that may wait for the next piece.
_LONGEST_TAG = len("</think>") - 1


def without_thoughts(pieces: Iterable[str]) -> Iterator[str]:
    """A reply's pieces as they come, without what stands between think tags, in any case and however the pieces fall.

    What may be the beginning of a tag is held back until it is one or isn't. An open tag hides the rest.
    """
    shown, waiting = True, ""
    for piece in chain(pieces, [None]):
        waiting += piece or ""
        done = 0
        for tag in _TAG.finditer(waiting):
            if shown and tag.start() > done:
                yield waiting[done : tag.start()]
            shown, done = bool(tag[1]), tag.end()
        waiting = waiting[done:]
        cut = waiting.rfind("<") if piece is not None else -1
        held = cut >= 0 and len(waiting) - cut <= _LONGEST_TAG and any(t.startswith(waiting[cut:].lower()) for t in ("<think>", "</think>"))
        ready, waiting = (waiting[:cut], waiting[cut:]) if held else (waiting, "")
        if shown and ready:
            yield ready


#: Characters of a part and of all parts in a summary context, digests of weeks, months and years that it takes, characters
#: of all notes in a precise reading, and what a fast reply says where its context doesn't hold the answer.
PART, PARTS, WEEKS, MONTHS, NOTES, INSUFFICIENT = 700, 4000, 9, 14, 16_000, "INSUFFICIENT"


def digests_for(plan: Plan, digests: DataFrame) -> DataFrame:
    """The digests (period_type, period_key, summary, last_day) that give an answer's background, oldest first."""
    kind = digest_kind(plan.since, plan.until)
    if kind is None or plan.intent != "narrative" and plan.since is None:
        return digests.limit(0)
    rows = filters.in_range(digests.where(F.col("period_type") == kind), plan.since, plan.until, "last_day")
    newest = rows.orderBy(F.desc("period_key")).limit(WEEKS if kind == "week" else MONTHS)
    return newest.orderBy("period_key")


def summary_context(plan: Plan, found: DataFrame, digests: DataFrame | None = None, notes: DataFrame | None = None, budget: int = FAST) -> str:
    """What a fast answer reads: digests, entries' summaries by day (their text where they have none), notes; whole blocks by priority.

    `found` (entry_id, entry_date, text, maybe summary), `notes` (title, summary). The driver reads the few rows that were retrieved.
    """
    held = []
    room = PARTS
    for row in sorted(found.collect(), key=lambda r: (r.entry_date, r.entry_id)):
        own = row.asDict()
        text_ = own.get("summary") or own["text"][: min(PART, max(room, 0))]
        room -= 0 if own.get("summary") else len(text_)
        held.append(f"[{row.entry_date}] {text_}")
    background = [f"({r.period_key}) {r.summary}" for r in digests_for(plan, digests).collect()] if digests is not None else []
    known = [f"{r.title}: {r.summary}" for r in notes.orderBy("title").collect()] if notes is not None else []
    kept = set(fit([*held, *known, *background], budget))
    return "\n".join(b for b in [*background, *held, *known] if b in kept)


def precise_context(found: DataFrame, notes: DataFrame | None = None, budget: int = PRECISE) -> str:
    """What a second, slower reading takes: whole texts by rank while they fit, notes within a share of the budget of their own."""
    known = fit([f"{r.title}: {r.text}" for r in notes.orderBy("title").collect()], NOTES) if notes is not None else []
    texts = [f"[{r.entry_date}]\n{r.text}" for r in found.collect()]
    return "\n\n".join([*known, *fit(texts, budget - sum(map(len, known)))])


def rewritten(question: str, history: list[tuple[str, str]], client) -> str:
    """A follow-up as a question of its own, by the model; without history, or where it fails, as it is."""
    if not history:
        return question
    told = "\n".join(f"Q: {q}\nA: {a}" for q, a in history[-6:])
    try:
        return client.complete(f"{told}\nRewrite as one question that stands alone: {question}").strip() or question
    except Exception:  # the plain question still has an answer
        return question


def finished(reply: str, days: list[date], titles: list[str]) -> str:
    """An answer with its sources: the days it names of those read, in order, then the notes it names, by name without case."""
    named = sorted((t for t in set(titles) if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", reply, re.I)), key=str.casefold)
    sources = [*(d.isoformat() for d in cited(reply, days)), *named]
    return reply.strip() + (f"\n\nSources: {', '.join(sources)}" if sources else "")


def answer(question: str, entries: DataFrame, client, today: date, digests: DataFrame | None = None, notes: DataFrame | None = None, history: list[tuple[str, str]] = ()) -> tuple[str, str]:
    """(stage, text): from a fast reading of summaries, or a precise one of whole texts where the fast one says it isn't enough."""
    question = rewritten(question, list(history), client)
    plan = route(question, today)
    found = with_day(retrieve(plan, entries), entries, plan.since if plan.since == plan.until else None)
    days, titles = [r.entry_date for r in found.select("entry_date").collect()], [r.title for r in notes.select("title").collect()] if notes is not None else []
    if not days:
        return "none", "Nothing written in that time."
    if not plan.needs_raw:
        reply = "".join(without_thoughts([client.complete(f"{summary_context(plan, found, digests, notes)}\n\nQuestion: {question}")]))
        if INSUFFICIENT not in reply:
            return "fast", finished(reply, days, titles)
    with_text = notes if notes is not None and "text" in notes.columns else None
    reply = "".join(without_thoughts([client.complete(f"{precise_context(found, with_text)}\n\nQuestion: {question}")]))
    return "precise", finished(reply, days, titles)


def prompts_context(entries: DataFrame, today: date, days: int = 14) -> DataFrame:
    """What writing prompts are made from: the last days' entries, oldest first."""
    return filters.in_range(entries, date.fromordinal(today.toordinal() - days), today).orderBy("entry_date", "entry_id")


def listed(reply: str, most: int = 5) -> list[str]:
    """The items of a reply that is a list, without marks, each once."""
    items = (re.sub(r"^(?:[-*+]|\d+[.)])\s*", "", line.strip()).strip('"') for line in reply.splitlines())
    return list(dict.fromkeys(i for i in items if i))[:most]
