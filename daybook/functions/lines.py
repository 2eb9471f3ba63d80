"""Lines of Markdown as words: marks of lists and tasks, and the sentences of running text."""

from __future__ import annotations

#: Marks of a list's items, what follows a number there, fences of code, ends of sentences.
BULLETS, AFTER_NUMBER, FENCES, SENTENCE_ENDS = ("-", "*", "+"), (".", ")"), ("```", "~~~"), (".", "!", "?")


def item(line: str) -> tuple[str, str, str]:
    """(mark with its indent, task box, words) of a list's item; of another line the mark and box are empty."""
    body = line.lstrip()
    mark = body.split(maxsplit=1)[0] if body else ""
    numbered = mark.endswith(AFTER_NUMBER) and mark[:-1].isdecimal()
    if mark == body or not (mark in BULLETS or numbered):
        return "", "", line
    words = body[len(mark) :].lstrip()
    box = words[:3] if words.startswith("[") and words[2:3] == "]" else ""
    return line[: len(line) - len(body)] + mark, box, words[len(box) :].lstrip()


def without_task_box(line: str) -> str:
    mark, box, words = item(line)
    return f"{mark} {words}" if box and mark.lstrip() in BULLETS else line


def sentences(text: str) -> list[str]:
    """Sentences of running text: marks go; headings, rows of tables and fenced code are skipped. A line's end is a sentence's end."""
    found, closing = [], ""
    for line in text.splitlines():
        bare = line.strip()
        if closing or bare.startswith(FENCES):
            closing = bare[:3] if not closing else "" if bare.startswith(closing) else closing
            continue
        if bare.startswith(("#", "|")):
            continue
        said: list[str] = []
        for word in item(line)[2].split():
            said.append(word)
            if word.endswith(SENTENCE_ENDS):
                found.append(" ".join(said))
                said = []
        if said:
            found.append(" ".join(said))
    return found


#: Endings that a word is looked up without, in the order in which they are tried; letters after which an s is no plural;
#: letters that stay doubled; least letters that an ending and a closing e leave.
ENDINGS, NO_PLURAL_AFTER, STAY_DOUBLED, LEAST_LEFT = ("ing", "ed", "es", "s", "ly"), "sui", "aeioulsfz", 3


def stem(word: str) -> str:
    """A crude stem: hike, hiked and hiking meet in hik, run and running in run, called in call."""
    word = word.casefold().strip("'-")
    roots = (word.removesuffix(e) for e in ENDINGS if word.endswith(e) and not (e == "s" and word[-2:-1] in tuple(NO_PLURAL_AFTER)))
    root = next((r for r in roots if len(r) >= LEAST_LEFT), word)
    if root != word and root[-1] == root[-2] and root[-1] not in STAY_DOUBLED:
        root = root[:-1]
    return root.removesuffix("e") if len(root) > LEAST_LEFT else root
