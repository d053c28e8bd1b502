"""What a text says: memories by type, simple facts, people and projects, and the query hidden in a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of each memory type, as patterns on lower-case text. Ties go to the earlier type.
MEMORY = {
    "decision": (
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\bi'?m going (to|with)\b", r"\bbetter (to|than|approach|option|choice)\b", r"\binstead of\b", r"\brather than\b",
        r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b", r"\bpros and cons\b", r"\bover\b.*\bbecause\b", r"\barchitecture\b", r"\bapproach\b", r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b", r"\binfrastructure\b",
        r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ),
    "preference": (
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b", r"\bi hate (when|how|it when)\b", r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b", r"\bfunctional\b.*\bstyle\b", r"\bimperative\b", r"\bsnake_?case\b", r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ),
    "milestone": (
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bnailed it\b", r"\bcracked (it|the)\b", r"\bfinally\b", r"\bfirst time\b", r"\bfirst ever\b",
        r"\bnever (done|been|had) before\b", r"\bdiscovered\b", r"\brealized\b", r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b", r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b", r"\bcreated\b",
        r"\bimplemented\b", r"\bshipped\b", r"\blaunched\b", r"\bdeployed\b", r"\breleased\b", r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b", r"\bversion \d", r"\bv\d+\.\d+", r"\d+x (compression|faster|slower|better|improvement|reduction)",
        r"\d+% (reduction|improvement|faster|better|smaller)",
    ),
    "problem": (
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b", r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b", r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b", r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b", r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b", r"\bpatched\b", r"\bthe answer (is|was)\b",
        r"\b(had|need) to\b.*\binstead\b",
    ),
    "emotional": (
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b", r"\bsorry\b", r"\bgrateful\b", r"\bangry\b", r"\bworried\b", r"\blonely\b", r"\bbeautiful\b",
        r"\bamazing\b", r"\bwonderful\b", r"i feel", r"i'm scared", r"i love you", r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone", r"nobody knows", r"\*[^*]+\*",
    ),
}
POSITIVE = "pride proud joy happy love loving beautiful amazing wonderful incredible fantastic brilliant perfect excited thrilled grateful warm breakthrough success works working solved fixed nailed heart hug precious adore".split()
NEGATIVE = "bug error crash crashing crashed fail failed failing failure broken broke breaking breaks issue problem wrong stuck blocked unable impossible missing terrible horrible awful worse worst panic disaster mess".split()
RESOLVED = r"\b(?:fixed|solved|resolved|patched|got it working|it works|nailed it|figured (?:it )?out|the (?:fix|answer|solution))\b"

#: Predicate, the verb between two names, confidence.
FACTS = (("is_a", r"is\s+an?", 0.7), ("works_at", r"works?\s+(?:at|for)", 0.75), ("lives_in", r"lives?\s+in", 0.7), ("loves", r"loves?", 0.6), ("uses", r"uses?", 0.5), ("prefers", r"prefers?", 0.6))
_NO_OBJECT = "the a an this that it them us you me i he she we they".split()


def memory_scores(text: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return {kind: sum((F.regexp_count(low, F.lit(p)) for p in patterns[1:]), F.regexp_count(low, F.lit(patterns[0]))) for kind, patterns in MEMORY.items()}


def sentiment(text: Column) -> Column:
    """Whether more of the positive or of the negative words are among the text's words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), F.lit(0)))
    lead = F.size(F.array_intersect(words, F.array(*map(F.lit, POSITIVE)))) - F.size(F.array_intersect(words, F.array(*map(F.lit, NEGATIVE))))
    return F.when(lead > 0, "positive").when(lead < 0, "negative").otherwise("neutral")


def memories(segments: DataFrame, text_col: str = "content", least: float = 0.3) -> DataFrame:
    """segments with memory_type and confidence, those of 20 characters that score enough.

    The type is that of most markers; resolved or cheerful problems are milestones or emotions. A fifth of the
    score, with 1 or 2 more for over 200 or 500 characters, is the confidence.
    """
    text = F.col(text_col)
    scores = memory_scores(text)
    rows = segments.where(F.char_length(F.trim(text)) >= 20).withColumns({f"__{k}": s for k, s in scores.items()} | {"__mood": sentiment(text)})
    each = {k: F.col(f"__{k}") for k in scores}
    best = F.greatest(*each.values())
    kind = F.coalesce(*[F.when((s == best) & (best > 0), k) for k, s in each.items()])
    resolved, cheerful = F.lower(text).rlike(RESOLVED), F.col("__mood") == "positive"
    final = F.when(kind != "problem", kind).when(resolved & cheerful & (each["emotional"] > 0), "emotional").when(resolved, "milestone").when(cheerful & (each["milestone"] > 0), "milestone").when(cheerful & (each["emotional"] > 0), "emotional").otherwise(kind)
    bonus = F.when(F.char_length(text) > 500, 2).when(F.char_length(text) > 200, 1).otherwise(0)
    out = rows.withColumn("memory_type", final).withColumn("confidence", F.least(F.lit(1.0), (best + bonus) / 5.0))
    return out.where((best > 0) & (F.col("confidence") >= least)).drop(*[c for c in rows.columns if c.startswith("__")])


def facts(texts: DataFrame, key: str, text_col: str = "document", hints: tuple[str, ...] = ()) -> DataFrame:
    """key, subject, predicate, object, confidence: 'Name verb object', the object up to a stop; the best of equal facts.

    A subject among the hints adds .15, up to .9. Facts that differ in case only are one, in the writing of the surest (of
    equally sure ones the first by name).
    """
    name = r"([A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){0,2})"
    thing = r"([a-zA-Z][\w\s'\-]{1,60}?)"
    found = None
    for predicate, verb, confidence in FACTS:
        ends = r"\s*(?:(?:\bover\b|\bto\b|[.,;!?])|$)" if predicate == "prefers" else r"\s*(?:[.,;!?]|$)"
        pattern = rf"\b{name}\s+(?i:{verb})\s+{thing}{ends}"
        text = F.coalesce(F.col(text_col), F.lit(""))
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("subject"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("object"))
        part = texts.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.subject").alias("subject"), F.lit(predicate).alias("predicate"), F.trim(F.regexp_replace(F.trim("p.object"), r"(?i)^(?:(?:an?|the)\s+)+", "")).alias("object"), F.lit(confidence).alias("confidence"))
        found = part if found is None else found.union(part)
    found = found.where((F.char_length("object") > 1) & ~F.lower("object").isin(*_NO_OBJECT))
    if hints:
        known = F.lower("subject").isin(*[h.lower() for h in hints])
        found = found.withColumn("confidence", F.when(known, F.least(F.col("confidence") + 0.15, F.lit(0.9))).otherwise(F.col("confidence")))
    best = F.min_by(F.struct("subject", "object", "confidence"), F.struct(-F.col("confidence"), "subject", "object")).alias("f")
    return found.groupBy(key, F.lower("subject").alias("s"), "predicate", F.lower("object").alias("o")).agg(best).select(key, "f.subject", "predicate", "f.object", "f.confidence")


def entity_candidates(texts: DataFrame, text_col: str = "document", least: int = 3) -> DataFrame:
    """name, frequency of capitalised words of two letters or more, over the whole corpus."""
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))).alias("name"))
    return words.where(F.char_length("name") > 1).groupBy("name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def entity_scores(lines: DataFrame, names: DataFrame) -> DataFrame:
    """For each name: frequency and signals of a person and of a project, from lines (key, n, line).

    Lines and names meet on the names' own words, never all with all. Weights: dialogue 3, verbs 2, a pronoun within
    two lines 2, direct address 4; project verbs 2, versions 3, code 3.
    """
    order = Window.partitionBy("key").orderBy("n").rowsBetween(-2, 2)
    around = lines.withColumn("pronoun", (F.max(F.col("line").rlike(r"(?i)\b(?:she|hers?|he|him|his|they|them|their)\b").cast("int")).over(order)))
    each = around.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))))).join(names, "name")

    def times(*patterns: str) -> Column:
        """Matches of patterns in which {} stands for the name."""
        parts = [F.regexp_count("line", F.concat(F.lit("(?i)" + p.split("{}")[0]), F.col("name"), F.lit(p.split("{}")[1]))) for p in patterns]
        return sum(parts[1:], parts[0])

    each = each.select(
        "name", "pronoun",
        times(r"^>\s*{}[:\s]", r"^{}:\s", r"^\[{}\]", r'"{}\s+said').alias("dialogue"),
        times(r"\b{}\s+(?:said|asked|told|replied|laughed|smiled|cried|felt|thinks?|wants?|loves?|hates?|knows?|decided|pushed|wrote)\b").alias("action"),
        times(r"\b(?:hey|thanks?|hi|dear)\s+{}\b").alias("address"),
        times(r"\b(?:building|built|ship(?:ping|ped)?|launch(?:ing|ed)?|deploy(?:ing|ed)?|install(?:ing|ed)?|import|pip\s+install)\s+{}\b", r"\bthe\s+{}\s+(?:architecture|pipeline|system|repo)\b").alias("project"),
        times(r"\b{}[-v]\w+").alias("versioned"), times(r"\b{}\.(?:py|js|ts|yaml|yml|json|sh)\b").alias("code"),
    )
    signals = ("dialogue", "action", "pronoun", "address", "project", "versioned", "code")
    total = each.groupBy("name").agg(*[F.sum(s).alias(s) for s in signals]).join(names, "name")
    person = 3 * F.col("dialogue") + 2 * F.col("action") + 2 * F.col("pronoun") + 4 * F.col("address")
    project = 2 * F.col("project") + 3 * F.col("versioned") + 3 * F.col("code")
    kinds = sum(((F.col(s) > 0).cast("int") for s in signals[1:4]), (F.col("dialogue") > 0).cast("int"))
    return total.select("name", "frequency", person.alias("person"), project.alias("project"), kinds.alias("kinds"))


def classify_entities(scores: DataFrame) -> DataFrame:
    """name, type (person, project, uncertain), confidence, frequency."""
    total = F.col("person") + F.col("project")
    ratio = F.when(total > 0, F.col("person") / total).otherwise(0.0)
    person = (ratio >= 0.7) & (F.col("kinds") >= 2) & (F.col("person") >= 5)
    kind = F.when(total == 0, "uncertain").when(person, "person").when(ratio >= 0.7, "uncertain").when(ratio <= 0.3, "project").otherwise("uncertain")
    sure = F.when(total == 0, F.least(F.lit(0.4), F.col("frequency") / 50)).when(person, F.least(F.lit(0.99), 0.5 + ratio * 0.5)).when(ratio >= 0.7, 0.4).when(ratio <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5)).otherwise(0.5)
    return scores.select("name", kind.alias("type"), F.round(sure, 2).alias("confidence"), "frequency")


def claims(texts: DataFrame, key: str, text_col: str = "document") -> DataFrame:
    """key, subject, predicate, object of "X is Y's role" and "Y's role is X"."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def find(pattern: str, s: int, p: int, o: int) -> DataFrame:
        got = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(c) for c, i in (("subject", s), ("predicate", p), ("object", o))])
        return texts.select(key, F.explode(got).alias("c")).select(key, "c.subject", F.lower("c.predicate").alias("predicate"), "c.object")

    return find(r"\b([A-Z]\w+)\s+is\s+([A-Z]\w+)'s\s+(\w+)", 1, 3, 2).union(find(r"\b([A-Z]\w+)'s\s+(\w+)\s+is\s+([A-Z]\w+)", 3, 2, 1))


def clean_query(query: Column, safe: int = 200, most: int = 250, least: int = 10) -> Column:
    """What a long prompt asks: the last line that ends as a question, else the last sentence or line, else its end."""
    text = F.trim(F.coalesce(query, F.lit("")))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= least)

    def bare(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.trim(s), r"""^["']+|["']+$""", ""))

    def short(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, r"[.!?。！？\n]+"), bare), lambda x: F.char_length(x).between(least, most))
        return F.when(F.char_length(s) <= most, s).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.trim(F.substr(s, F.greatest(F.char_length(s) - (most - 1), F.lit(1))))))

    asked = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"""[?？]\s*["']?\s*$""")), F.lit(-1))
    tail = F.try_element_at(lines, F.lit(-1))
    return F.when(F.char_length(text) <= safe, text).otherwise(F.coalesce(short(asked), short(bare(tail)), F.trim(F.substr(text, F.greatest(F.char_length(text) - (most - 1), F.lit(1))))))


#: Tags and line beginnings that chat tools add to transcripts.
NOISE_TAGS = ("system-reminder", "command-message", "command-name", "task-notification", "user-prompt-submit-hook", "hook_output")
NOISE_LINES = ("CURRENT TIME:", "VERIFIED FACTS (do not contradict)", "AGENT SPECIALIZATION:", "Checking verified facts...", "Injecting timestamp...", "Starting background pipeline...", "Checking emotional weights...", "Auto-save reminder...", "Checking pipeline...")


def without_noise(text: Column) -> Column:
    """A transcript without the tools' own tags and lines; four line ends or more become three."""
    import re

    out = text
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?m)^(?:> )?<{tag}(?:\s[^>]*)?>(?:(?!\n\s*\n)[\s\S])*?</{tag}>[ \t]*\n?", "")
    for line in NOISE_LINES:
        out = F.regexp_replace(out, rf"(?m)^(?:> )?{re.escape(line)}.*\n?", "")
    out = F.regexp_replace(out, r"(?m)^(?:> )?Ran \d+ (?:Stop|PreCompact|PreToolUse|PostToolUse|UserPromptSubmit|Notification|SessionStart|SessionEnd) hooks?.*\n?", "")
    out = F.regexp_replace(out, r"(?m)^(?:> )?…\s*\+\d+ lines.*\n?", "")
    out = F.regexp_replace(out, r"\s*\[\d+\s+tokens?\]\s*\(ctrl\+o to expand\)", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def prose(text: Column) -> Column:
    """The lines outside code fences that don't look like code; the whole text if none is left."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    fence = F.transform(lines, lambda x: F.trim(x).startswith("```"))
    code = (
        r"^(?:[$#]\s|(?:cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s|(?:import|from|def|class|function|const|let|var|return)\s|[A-Z_]{2,}=|\||-{2,}|[{}\[\]]$"
        r"|(?:if|for|while|try|except|elif|else:)\b|\w+\.\w+\(|\w+ = \w+\.\w+)"
    )

    def plain(x: Column, i: Column) -> Column:
        bare = F.trim(x)
        letters = F.char_length(F.regexp_replace(bare, r"[^\p{L}]", ""))
        inside = F.size(F.filter(F.slice(fence, F.lit(1), i + 1), lambda f: f)) % 2 == 1
        return ~inside & ~F.get(fence, i) & ((bare == "") | ~(bare.rlike(code) | ((F.char_length(bare) > 10) & (letters < 0.4 * F.char_length(bare)))))

    kept = F.regexp_replace(F.array_join(F.filter(lines, plain), "\n"), r"^\s+|\s+$", "")
    return F.when(kept != "", kept).otherwise(text)
