"""What depends on order within one text or one small pool: plain Python for Arrow batches, never over all rows."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from html import unescape

CJK_RUN = re.compile(r"[一-鿿㐀-䶿぀-ヿ가-힯]+")
LATIN = re.compile(r"[^\W_一-鿿㐀-䶿぀-ヿ가-힯]+")
# Where texts are split, the coarsest first.
SEPARATORS = ("\n\n", "\n", "。", ". ", " ", "")
STRUCTURE = re.compile(r"(?m)^(?=#{1,6} |[-*•] |\d+[.)] |[A-Z][\w .]{0,30}: )")
UNIT = re.compile(r"(?m)^(?=(?:topic|agenda|item)\b)", re.IGNORECASE)
ZH_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
ZH_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}


def tokens(text: str) -> int:
    return len(re.findall(r"[a-zA-Z0-9_]+|[^\x00-\x7f]|[^\sa-zA-Z0-9_]", text))


def multilingual_tokens(text: str | None, least: int = 2) -> list[str]:
    """Case-folded Latin words, and pairs of neighbours of CJK runs; a run of one is itself."""
    t = unicodedata.normalize("NFKC", text or "").casefold().replace("_", " ")
    out = [w for w in LATIN.findall(t) if len(w) >= least]
    for run in CJK_RUN.findall(t):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


# A comment, the start or end of an element, or another declaration; one that is never closed reaches to the end.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)


def visible_text(html: str | None) -> str:
    """What a page shows, with entities read and spaces single. Script and style hide what follows until they have ended as
    often as they began, even where they are written as closed; within them nothing but their own end is markup."""
    source, at, open_, shown = html or "", 0, 0, []
    while mark := MARKUP.search(source, at):
        if not open_:
            shown.append(source[at : mark.start()])
        at = mark.end()
        name = (mark["name"] or "").lower()
        if name in ("script", "style"):
            open_ = max(0, open_ - 1) if mark["end"] else open_ + 1
            if not mark["end"] and not mark["rest"].endswith("/"):
                end = re.compile(f"</{name}", re.IGNORECASE).search(source, at)
                at = end.start() if end else len(source)
    if not open_:
        shown.append(source[at:])
    return " ".join(unescape("".join(shown)).split())


def pretty_json(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (ValueError, TypeError):
        return text


def parsed_json(text: str | None) -> str | None:
    """JSON of a model's answer: without fences, as a whole, else the first object or array that parses."""
    t = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    decoder = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[{\[]", t))]:
        try:
            return json.dumps(decoder.raw_decode(t, at)[0] if at else json.loads(t), ensure_ascii=False)
        except ValueError:
            continue
    return None


def split_text(text: str, size: int, overlap: int, count: Callable[[str], int] = tokens, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` tokens, cut at the coarsest separator that serves, the next starting with up to
    ``overlap`` tokens of the last. The rest of an unbreakable run is cut by characters."""
    if count(text) <= size:
        return [text] if text.strip() else []
    at = next((s for s in separators if s and s in text), "")
    raw = text.split(at) if at else [text[i : i + size] for i in range(0, len(text), size)]
    parts = [p + at for p in raw[:-1]] + raw[-1:]
    finer = separators[separators.index(at) + 1 :] if at else ("",)
    out: list[str] = []
    now: list[tuple[str, int]] = []
    used = 0

    def flush() -> None:
        nonlocal now, used
        if now and (piece := "".join(p for p, _ in now).strip()):
            out.append(piece)
        while now and used > overlap:
            used -= now.pop(0)[1]

    for part in parts:
        n = count(part)
        if n > size and at:
            flush()
            now, used = [], 0
            out += split_text(part, size, overlap, count, finer)
            continue
        if used + n > size:
            flush()
            while now and used + n > size:
                used -= now.pop(0)[1]
        now.append((part, n))
        used += n
    overlap = 0
    flush()
    return out


def parents_and_children(text: str, parent: int = 384, child: int = 160, overlap: int = 64, child_overlap: int = 24) -> list[tuple[int, int, int, str]]:
    """(parent, its place, child number, child); a parent's place is found going forward."""
    rows, at = [], 0
    for i, p in enumerate(split_text(text, parent, overlap)):
        found = text.find(p, at)
        found = found if found >= 0 else text.find(p)
        at = max(at, found + 1)
        rows += [(i, found, j, c) for j, c in enumerate(split_text(p, child, child_overlap))]
    return rows


def packed_parts(parts: list[str], most: int, count: Callable[[str], int], joint: str) -> list[str]:
    out: list[str] = []
    now: list[str] = []
    used = 0
    for part in parts:
        n = count(part)
        if now and used + n > most:
            out.append(joint.join(now))
            now, used = [], 0
        now.append(part)
        used += n
    return out + ([joint.join(now)] if now else [])


def structure_packed(text: str, most: int) -> list[str]:
    """Parts that begin at headings, list items or speakers, packed greedily up to ``most`` characters."""
    return packed_parts([p for p in STRUCTURE.split(text) if p.strip()], most, len, "")


def paragraphs_packed(text: str, budget: int, count: Callable[[str], int] = tokens) -> list[str]:
    """Paragraphs packed up to half a token budget; a longer one is cut."""
    half = max(1, budget // 2)
    parts = [q for p in re.split(r"\n\s*\n|\n", text) if p.strip() for q in (split_text(p, half, 0, count) if count(p) > half else [p])]
    return packed_parts(parts, half, count, "\n\n")


def windows(text: str, size: int = 5000, overlap: int = 300) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows that end at a line end of their back half if there is one."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (cut := text.rfind("\n", start + size // 2, end)) > 0:
            end = cut + 1
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def boundaries(vectors: list, threshold: float = 0.5, least: int = 2, most: int = 20) -> list[int]:
    """Segments before which a chunk begins: unlike the one before, once there are ``least``; at ``most`` in any case."""
    import numpy as np

    out, n = [], 1
    for i in range(1, len(vectors)):
        a, b = np.asarray(vectors[i - 1], float), np.asarray(vectors[i], float)
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        if n >= most or (n >= least and (float(a @ b) / size if size else 0.0) < threshold):
            out.append(i)
            n = 0
        n += 1
    return out


def grouped_segments(segments: list[dict], starts: list[int], most: int, on_speaker: bool = False) -> list[dict]:
    """Chunks of segments (start, end, text, speaker): a new one at a start, past ``most`` characters or at a new speaker."""
    out: list[dict] = []
    now: list[dict] = []

    def flush() -> None:
        if now:
            chars: dict[str, int] = {}
            for s in now:
                chars[s["speaker"]] = chars.get(s["speaker"], 0) + len(s["text"])
            out.append({"start": now[0]["start"], "end": now[-1]["end"], "speaker": max(chars, key=chars.get), "speakers": list(chars), "text": " ".join(s["text"] for s in now)})

    for i, s in enumerate(segments):
        if now and (i in starts or sum(len(x["text"]) for x in now) + len(s["text"]) > most or (on_speaker and s["speaker"] != now[-1]["speaker"])):
            flush()
            now = []
        now.append(s)
    flush()
    return out


def merged_words(words: list[dict]) -> list[dict]:
    """Segments of words (start and end in milliseconds, text, speaker) while the speaker stays."""
    out: list[dict] = []
    for w in words:
        if out and out[-1]["speaker"] == w["speaker"]:
            out[-1]["end"], out[-1]["text"] = round(w["end"] / 1000, 2), f"{out[-1]['text']} {w['text']}"
        else:
            out.append({"start": round(w["start"] / 1000, 2), "end": round(w["end"] / 1000, 2), "text": w["text"], "speaker": w["speaker"]})
    return out


def topic_units(text: str, most: int = 6000) -> list[tuple[int, str]]:
    """(topic, unit): units split where a topic is named, a topic lasting until the next; long units are cut by lines."""
    out, topic = [], 0
    for part in UNIT.split(text):
        if UNIT.match(part):
            topic += 1
        if part.strip():
            out += [(topic, p) for p in packed_parts(part.splitlines(keepends=True), most, len, "")]
    return out


def blocks(source: str, pages: list[str]) -> list[tuple[int, int, int, str]]:
    """(page, start, end, text) of paragraphs, each page looked for from where the last ended."""
    out, at = [], 0
    for k, page in enumerate(pages):
        found = source.find(page, at)
        if found < 0:
            continue
        out += [(k, found + m.start(), found + m.end(), m[0]) for m in re.finditer(r"\S(?:.*?\S)??(?=\s*\n\s*\n|\s*\Z)", page, re.DOTALL)]
        at = found + len(page)
    return out


def grams(text: str, n: int = 4) -> set[str]:
    t = text.strip().lower()
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))}


def mmr(texts: list[str], scores: list[float], k: int, weight: float = 0.8) -> list[int]:
    """Places in order of choice: most of weight * relevance - (1 - weight) * likeness to what is chosen; ties to the first."""
    low, high = min(scores, default=0), max(scores, default=0)
    relevance = [(s - low) / (high - low) if high > low else 1 / (1 + i) for i, s in enumerate(scores)]
    sets = [grams(t) for t in texts]
    like, chosen = [0.0] * len(texts), []
    left = list(range(len(texts)))
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (weight * relevance[i] - (1 - weight) * like[i], -i))
        chosen.append(best)
        left.remove(best)
        for i in left:
            like[i] = max(like[i], len(sets[i] & sets[best]) / min(len(sets[i]), len(sets[best])))
    return chosen


def apportioned(weights: list[float], total: int, least: int, most: int) -> list[int]:
    """Largest remainders between bounds; seats that a bound gives or takes are dealt to the others again."""
    w = [max(x, 0.15) for x in weights]
    out = [least] * len(w)
    left = total - sum(out)
    while left > 0 and (open_ := [i for i in range(len(w)) if out[i] < most]):
        share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
        given = {i: min(int(share[i]), most - out[i]) for i in open_}
        for i in sorted(open_, key=lambda i: (-(share[i] - int(share[i])), i)):
            if sum(given.values()) < left and out[i] + given[i] < most:
                given[i] += 1
        if not any(given.values()):
            break
        for i, n in given.items():
            out[i] += n
        left = total - sum(out)
    return out


def rouge_l(reference: str, hypothesis: str) -> float:
    """F1 of the longest common subsequence. A row of its table is one integer, a bit for each word of ``a``, in which the
    length rises where a bit is 0."""
    a, b = reference.split(), hypothesis.split()
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & every
    common = len(a) - row.bit_count()
    if not common:
        return 0.0
    precision, recall = common / len(b), common / len(a)
    return 2 * precision * recall / (precision + recall)


def zh_number(text: str | None) -> float | None:
    """A Chinese or Arabic numeral, with one half and a decimal point understood."""
    t = (text or "").strip()
    try:
        return float(t)
    except ValueError:
        pass
    if t == "半":
        return 0.5
    if "点" in t:
        whole, _, part = t.partition("点")
        a = zh_number(whole or "零")
        digits = [ZH_DIGITS.get(c) for c in part]
        return None if a is None or None in digits or not digits else float(f"{int(a)}.{''.join(map(str, digits))}")
    total, section, digit, seen = 0, 0, None, False
    for c in t:
        if c in ZH_DIGITS:
            digit, seen = ZH_DIGITS[c], True
        elif c in ZH_UNITS:
            unit, seen = ZH_UNITS[c], True
            if unit == 10000:
                total, section, digit = (total + section + (digit or 0)) * unit, 0, None
            else:
                section, digit = section + (1 if digit is None else digit) * unit, None
        else:
            return None
    return float(total + section + (digit or 0)) if seen else None


def temporal_hint(question: str) -> tuple[str, float, float] | None:
    """('seconds', from, to), negative counted from the end, or ('ratio', from, to) of the whole."""
    q = question.lower()
    if m := re.search(r"\b(first|last)\s+(\d+(?:\.\d+)?|a|an|one|two|three|five|ten|half an?)?\s*(second|minute|hour)s?\b", q):
        words = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "five": 5, "ten": 10, "half a": 0.5, "half an": 0.5, None: 1}
        n = words[m[2]] if m[2] in words else float(m[2])
        n *= {"second": 1, "minute": 60, "hour": 3600}[m[3]]
        return ("seconds", 0.0, float(n)) if m[1] == "first" else ("seconds", -float(n), 0.0)
    for words_, span in ((("beginning", "opening", "at the start"), (0.0, 0.25)), (("middle", "halfway"), (0.4, 0.6)), (("end of", "closing", "conclusion"), (0.75, 1.0))):
        if any(w in q for w in words_):
            return ("ratio", *span)
    return None


def historical_cutoffs(question: str) -> list[str]:
    """Dates (ISO) that an as-of marker within 40 characters binds; two and more only if the question compares."""
    dates = [(m.start(), m[0]) for m in re.finditer(r"\b\d{4}-\d{2}-\d{2}\b", question)]
    markers = [m.start() for m in re.finditer(r"\b(?:as of|as at|by|before|until|back on)\b", question.lower())]
    bound = [d for at, d in dates if any(0 <= at - m <= 40 for m in markers)]
    compares = re.search(r"\b(?:compare|between|change[ds]?|differ\w*|versus)\b", question.lower())
    return sorted(d for _, d in dates) if len(dates) >= 2 and compares else bound[:1]


def speaker_names(question: str, known: list[str]) -> list[str]:
    """Known names at word boundaries in either case; else capitalised names after a verb of speech; else none."""
    found = [k for k in known if re.search(rf"(?<!\w){re.escape(k)}(?!\w)", question, re.IGNORECASE)]
    return found or re.findall(r"\b(?:did|does|has|was|by|from)\s+([A-Z][a-z]+)\b(?=\s+(?:say|said|mention|ask|suggest|propose|explain)|[?.!]|$)", question)


def supported(value: str, evidence: str, least: float = 0.6) -> bool:
    """Is a value in the evidence literally, or does one clause hold enough of its tokens, its numbers and its polarity?"""
    norm = lambda t: re.sub(r"[^\w]+", "", unicodedata.normalize("NFKC", t).casefold())
    if norm(value) and norm(value) in norm(evidence):
        return True
    own = set(multilingual_tokens(value))
    if not own:
        return False
    least = 0.35 if CJK_RUN.search(value) else least
    negative = lambda words: bool(words & {"not", "no", "never", "without", "cannot"})
    for clause in re.split(r"[.!?;\n。！？；]+", evidence):
        words = set(multilingual_tokens(clause))
        digits = {w for w in own if w[0].isdigit()}
        if digits <= words and negative(own) == negative(words) and len(own & words) / len(own) >= least:
            return True
    return False


def relation_supported(subject: str, cue: str, target: str, evidence: str) -> bool:
    """Does a clause hold subject, cue and object in this order, close together?"""
    pattern = re.compile(rf"(?<!\w){re.escape(subject)}\W+(?:\w+\W+){{0,3}}?{re.escape(cue)}\w*\W+(?:\w+\W+){{0,3}}?{re.escape(target)}(?!\w)", re.IGNORECASE)
    return any(pattern.search(c) for c in re.split(r"[.!?;\n]+", evidence))


def snapshot_covered(before: str, after: str, least: float = 0.75) -> bool:
    """Does an answer still hold three quarters of another's tokens and every number?"""
    stem = lambda w: re.sub(r"(?:ing|ed|es|s)$", "", w) if len(w) > 4 else w
    a, b = ({stem(w) for w in multilingual_tokens(t)} for t in (before, after))
    return not a or ({w for w in a if w.isdigit()} <= b and len(a & b) / len(a) >= least)


def flattened(payload: dict, prefix: str = "") -> dict[str, float]:
    out: dict[str, float] = {}
    for k, v in payload.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flattened(v, f"{name}.")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[name] = float(v)
    return out


def regressions(old: dict, new: dict, threshold: float = 0.05) -> list[str]:
    """Names of metrics that got worse by more than a share; times, latencies and errors are better when lower."""
    a, b, out = flattened(old), flattened(new), []
    for k in sorted(a.keys() & b.keys()):
        lower = re.search(r"latency|p\d\d|seconds|error", k) is not None
        change = (b[k] - a[k]) / abs(a[k]) if a[k] else float(b[k] != 0)
        if (change if lower else -change) > threshold:
            out.append(k)
    return out
