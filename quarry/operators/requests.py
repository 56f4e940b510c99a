"""Reading a learner's request: counts, level, style, difficulty and topic; what a routed request goes through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: A number of items that is asked for, and words that announce a second step.
COUNT = r"\b(\d{1,3})\s*(?:\w+[- ]){0,2}?(?:questions?|mcqs?|items?|cards?|flashcards?|problems?)\b"
SECOND = r"(?i)\b(then|after that|afterwards|followed by|and then)\b"
#: What is looked for in the text, in this order, for each parameter.
LEVELS = (
    ("beginner", ("beginner", "simple terms", "layman", "in plain english")),
    ("undergraduate", ("undergrad",)),
    ("graduate", ("postgrad", "graduate level")),
    ("expert", ("expert", "at a high level", "rigorous")),
)
STYLES = (
    ("analogy", ("analogy", "metaphor")),
    ("socratic", ("socratic", "guide me")),
    ("concise", ("short", "brief", "quick")),
    ("example_based", ("example",)),
    ("mathematical", ("equation", "mathematic", "derivation")),
    ("detailed", ("detailed", "in depth", "thorough")),
)
DIFFICULTIES = (
    ("easy", ("easy", "beginner quiz")),
    ("hard", ("hard", "difficult")),
    ("expert", ("expert", "olympiad", "tricky")),
    ("medium", ("medium", "moderate")),
)
#: What comes before a topic, words that end it, and topics that say nothing.
LEAD_NOISE = r"\b(?:like\s+(?:i\s*(?:am|'m)\s+)?(?:a\s+)?(?:beginner|high\s+school|undergrad\w*|expert)|in\s+(?:simple|layman|plain)\s+(?:terms|english)|as\s+a\s+(?:beginner|student)|for\s+a\s+beginner)\b"
TOPIC = r"\b(?:quiz me on|test me on|teach me|flashcards? (?:on|about|for)|explain|about|regarding|concerning|on|for|of)\s+(?:the\s+)?(.+)"
TAIL_NOISE = r"(?:\s+(?:in|on|of|for|and|with|to|a|an|the|is|are|how|why|what|that|it))*\s*$"
BREAKS = ("with", "using", "please", "then", "quickly", "briefly", "afterwards", "step", "steps")
REJECT = ("this", "that", "it", "them", "these", "those", "notes", "material", "everything", "my notes", "the notes", "my material", "the material", "all", "anything")
EDGES = r"""^[.,;:?!'"()]+|[.,;:?!'"()]+$"""
#: The stages of each intent.
STAGES = {
    "explain": "retrieve tutor verify", "answer": "retrieve knowledge verify", "summarize": "retrieve compress knowledge",
    "compare": "retrieve_per_document knowledge conflict_check", "quiz": "retrieve quiz validate_grounding",
    "exam": "retrieve_per_topic quiz validate_grounding grade", "flashcards": "retrieve flashcards validate_grounding",
    "plan": "progress_lookup planner", "paper_analysis": "load_document research critique",
    "research": "retrieve web_search research synthesise", "socratic": "retrieve socratic evaluate", "search": "retrieve rank",
    "progress": "progress_lookup", "small_talk": "reply", "unclear": "clarify",
}
WORKFLOWS = {i: {"plan": "planning_pipeline"}.get(i, f"{i}_pipeline") for i in STAGES}
#: What is suggested after an answer of each intent; {} is the topic.
FOLLOW_UPS = {
    "explain": ("Quiz me on {}", "Make 10 flashcards for {}", "Why does {} matter?"),
    "answer": ("Explain {} simply", "What else does my material say about {}?", "Test me on {}"),
    "quiz": ("Make it harder", "Explain why question 1 has that answer", "Turn this into flashcards"),
    "flashcards": ("Quiz me on {}", "Plan revision for {}"),
    "research": ("Summarise {} from my documents only", "What is still unknown about {}?"),
    "plan": ("Quiz me on my weakest topic", "Halve the time in this plan"),
    "socratic": ("Reveal the answer", "Give me a hint", "Explain it properly instead"),
    "paper_analysis": ("What are the research gaps?", "Explain the methodology"),
}
OTHERWISE = ("Explain {}", "What am I weak at?")
#: What a learner says who wants the answer, and the questions of a guided dialogue; {} is the topic.
GIVE_UP = ("just tell me", "tell me the answer", "give me the answer", "what is the answer", "i give up", "no idea", "i don't know", "stop hinting", "answer now", "just answer", "reveal", "ok give me")
PROBES = (
    "What is the simplest case of {} you can think of?",
    "Which quantity in that case changes, and by how much?",
    "Why would that change happen physically?",
    "What would happen if you doubled that quantity?",
    "Can you now state the general principle in one sentence?",
)
MOST_SCAFFOLD = 5


def first_of(low: Column, table) -> Column:
    """The first name any of whose words the lower-case text has."""
    out = F.lit(None).cast("string")
    for name, words in reversed(table):
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def count_of(low: Column) -> Column:
    return F.nullif(F.regexp_extract(low, COUNT, 1), F.lit("")).cast("int")


def topic_of(low: Column) -> Column:
    """The phrase behind a lead word, up to the first number, gap or word that begins another clause."""
    rest = F.regexp_extract(F.regexp_replace(low, LEAD_NOISE, " "), TOPIC, 1)
    words = F.transform(F.slice(F.split(rest, r"[\s,]+"), 1, 14), lambda w: F.regexp_replace(w, EDGES, ""))
    ends = F.transform(words, lambda w, i: (w == "") | w.rlike(r"^\d+$") | ((i > 0) & w.isin(*BREAKS)))
    stop = F.array_position(F.array_append(ends, F.lit(True)), F.lit(True)).cast("int")
    topic = tx.strip(F.regexp_replace(F.array_join(F.slice(words, F.lit(1), stop - 1), " "), TAIL_NOISE, ""))
    return F.when(~topic.isin(*REJECT) & (F.length(topic) >= 3), topic)


def item_count(intent: Column, difficulty: Column, count: Column) -> Column:
    """Questions that a quiz or paper gets."""
    return F.when(count > 0, F.least(count, F.lit(30))).when(intent == "exam", 20).when(difficulty.isin("hard", "expert"), 8).otherwise(6)


def lookup(key: Column, table: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def follow_ups(intent: Column, topic: Column) -> Column:
    """Suggestions, one a line."""
    lines = lookup(intent, {k: "\n".join(v) for k, v in FOLLOW_UPS.items()}, "\n".join(OTHERWISE))
    return F.replace(lines, F.lit("{}"), F.coalesce(topic, F.lit("this topic")))


def gives_up(low: Column) -> Column:
    return F.coalesce(low.rlike("|".join(GIVE_UP)), F.lit(False))


def probe(question: Column, level: Column) -> Column:
    """The question of a guided dialogue at a level of help, from 1."""
    subject = F.regexp_replace(tx.strip(question), r"\?+$", "")
    texts = F.array(*map(F.lit, PROBES))
    return F.replace(F.get(texts, F.least(F.greatest(level, F.lit(1)), F.lit(len(PROBES))) - 1), F.lit("{}"), subject)
