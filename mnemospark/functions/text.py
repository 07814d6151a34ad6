"""Text rules as Catalyst expressions.  Tokens follow Unicode letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9_][\p{L}\p{N}_]+"

# Words that carry no topic.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "has", "have", "had", "his", "its",
    "that", "this", "with", "from", "they", "will", "would", "there", "their", "what", "about", "which", "when", "were", "been", "than",
    "then", "them", "into", "over", "only", "some", "such", "very", "is", "it", "in", "on", "of", "to", "an", "as", "at", "be", "by", "do",
    "if", "or", "so", "no", "we", "he", "my", "me", "up",
)
# Signals of the write gate.
HIGH_VALUE_TAGS = ("preference", "workflow", "solution", "error", "fix", "knowledge", "fact", "opinion", "user", "project", "偏好", "工作流", "解决方案", "错误", "知识")
SUBSTANCE = (
    "因为", "所以", "原因", "方案", "步骤", "配置", "部署", "测试", "because", "therefore", "solution", "step", "config", "deploy", "test",
    "error", "bug", "fix", "解决", "修复", "prefer", "like", "want", "need", "喜欢", "想要", "需要", "偏好",
)
# Words that only fill, and reactions with how much they are noise, in the order they are tried.
FILLERS = ("um", "uh", "er", "嗯", "啊", "哦", "呃", "那个", "这个", "就是", "maybe", "perhaps", "大概", "可能", "好像")
NOISE = (
    (r"^(ok|okay|好的|嗯|哦|知道了|明白了|懂了|收到)[\s\.。!！]*$", 0.95),
    (r"^(thanks|谢谢|thank you|thx|3q)[\s\.。!！]*$", 0.9),
    (r"^(ha{2,}|呵{2,}|笑|w{2,}|草{2,})[\s\.。!！]*$", 0.95),
    (r"^(yes|no|对|不对|是|不是|可以|不可以)$", 0.8),
    (r"^[a-z]{1,3}$", 0.85),
    (r"^[\x{1F300}-\x{1F9FF}\x{1FA70}-\x{1FABF}\x{2600}-\x{27BF}\x{FE0F}]+$", 0.98),
    (r"^(hi|hello|hey|嗨|你好|早|早上好|晚上好)[\s\.。!！]*$", 0.7),
    (r"^[/!][a-z]+(\s|$)", 0.6),
)
# Wordings that say how one memory leads to another, by relation.
CAUSAL = {
    "causes": (r"(?:causes?|leads? to|results? in|triggers?|produces?)\s+", r"(?:导致|引起|造成|触发|产生)\s*", r"(?:because|since|due to|as a result of)\s+", r"(?:因为|由于|所以|因此)\s*"),
    "depends_on": (r"(?:depends? on|requires?|needs?|relies? on)\s+", r"(?:依赖|需要|依靠|取决于)\s*", r"(?:prerequisite|必须先|前置)\s*"),
    "motivates": (r"(?:motivates?|drives?|inspires?|encourages?)\s+", r"(?:推动|激励|促使|驱动)\s*", r"(?:goal|aim|purpose|objective)\s+(?:is|was)\s+to\s+"),
    "goal_of": (r"(?:in order to|so that|to achieve|toward)\s+", r"(?:为了|以便|旨在|目标是)\s*", r"(?:step|phase|milestone|subtask)\s+(?:of|for)\s+"),
    "result_of": (r"(?:output|outcome|result|consequence|product)\s+(?:of|from)\s+", r"(?:结果|产出|成果|产物)\s*", r"(?:as a (?:result|consequence)|thus|therefore|hence)\s+"),
    "precedes": (r"(?:before|prior to|preceding|earlier than)\s+", r"(?:之前|先于|早于|在.*之前)\s*", r"(?:first|initially|originally)\s+.+(?:then|later|after|随后)"),
}
# Wordings of goals with the confidence of each, and of beliefs about the user.
GOALS = (
    (r"(?i)(?:need to|have to|must|should|gotta|gonna|will|plan to|going to)\s+([^.\n]+)", 0.7),
    (r"(?i)(?:需要|必须|要|将会|打算|计划)\s*([^。\n]+)", 0.7),
    (r"(?i)(?:working on|implementing|building|fixing|debugging)\s+([^.\n]+)", 0.6),
    (r"(?i)(?:TODO|FIXME|TASK)[: ]\s*([^.\n]+)", 0.8),
)
# Wordings of beliefs about the user.
BELIEFS = (r"(?i)(?:user|用户)\s*(?:prefers?|likes?|uses?|works? with|knows?|is|has|wants?)\s+([^.\n]+)", r"(?i)(?:用户|user)\s*(?:偏好|喜欢|使用|了解|熟悉|知道|想要)\s*([^。\n]+)")
# Wordings of facts, in the order they are tried.
PREFERENCE = ("prefer", "like", "want", "don't like", "hate", "love", "always use", "never use", "favorite", "need", "doesn't like", "do not like")
CHANGE = ("fixed", "configured", "set up", "increased", "decreased", "changed", "updated", "installed", "deployed", "improved")
OUTCOME = ("performance improved", "after", "resulted in", "led to", "caused", "resolved")

# Words that speak for and against each trait of the user, for each style of learning, and for each value.
TRAITS = {
    "openness": (
        ("curious", "explore", "learn", "new", "experiment", "creative", "idea", "interesting", "discover", "try", "好奇", "探索", "学习", "创新", "尝试", "新"),
        ("stick to", "familiar", "comfort zone", "same", "routine", "保守", "习惯"),
    ),
    "conscientiousness": (
        ("plan", "organize", "schedule", "todo", "checklist", "test", "review", "refactor", "clean", "document", "计划", "整理", "测试", "重构", "文档"),
        ("hack", "quick fix", "shortcut", "skip", "messy", "临时", "快速修复", "跳过"),
    ),
    "extraversion": (("discuss", "share", "talk", "meeting", "collaborate", "team", "together", "pair", "讨论", "分享", "合作", "团队"), ("alone", "quiet", "solo", "单独", "安静")),
    "agreeableness": (
        ("agree", "nice", "good point", "makes sense", "helpful", "appreciate", "thanks", "同意", "好的", "谢谢"), ("disagree", "wrong", "no", "bad", "terrible", "不同意", "不对", "不好"),
    ),
    "neuroticism": (("anxious", "worry", "stress", "nervous", "frustrated", "overwhelm", "panic", "焦虑", "担心", "压力"), ("calm", "relax", "fine", "confident", "sure", "平静", "放松", "自信")),
}
LEARNING = {
    "reading": ("read", "doc", "documentation", "article", "blog", "阅读", "文档", "文章"), "doing": ("try", "build", "implement", "code", "write", "run", "试", "构建", "实现", "写"),
    "asking": ("ask", "question", "help", "how to", "请教", "帮助", "怎么"),
}
VALUES = {
    "efficiency": ("fast", "quick", "efficient", "optimize", "performance", "快", "高效", "优化", "性能"), "simplicity": ("simple", "clean", "minimal", "straightforward", "简单", "简洁", "干净"),
    "reliability": ("stable", "reliable", "robust", "test", "production", "稳定", "可靠", "健壮", "测试"), "learning": ("learn", "understand", "knowledge", "grow", "学习", "理解", "知识"),
    "autonomy": ("own", "control", "custom", "self", "自己", "控制", "自主"),
}


def tokens(c: Column | str) -> Column:
    """Tokens of two characters or more, in lower case, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def keywords(c: Column | str) -> Column:
    """Distinct tokens without stop words, in order."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_sort(F.array_except(F.array_distinct(tokens(c)), stop))


def bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring letters, in lower case; none for shorter texts."""
    low = F.lower(c)
    pairs = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))
    return F.when(F.length(low) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def count_contained(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains."""
    return sum((F.when(F.contains(c, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def noise(c: Column) -> Column:
    """How much a text is noise: a known reaction, few meaningful tokens, or mostly fillers."""
    low = F.lower(F.trim(c))
    found = F.regexp_extract_all(low, F.lit(r"[一-鿿]+|[a-z]{3,}"), F.lit(0))
    fillers = F.size(F.filter(found, lambda x: x.isin(*FILLERS)))
    words = F.size(F.filter(F.split(low, r"\s+"), lambda x: x != ""))
    density = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.size(found) / F.greatest(F.lit(5), words)))
    out = F.when(low.rlike(NOISE[0][0]), NOISE[0][1])
    for pattern, score in NOISE[1:]:
        out = out.when(low.rlike(pattern), score)
    return out.when(F.size(found) == 0, 0.9).when(fillers / F.size(found) > 0.5, 0.6).otherwise(density)


def emotional_noise(c: Column, valence: Column) -> Column:
    e = F.abs(valence)
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    ratio = F.size(F.array_distinct(words)) / F.greatest(F.lit(1), F.size(words))
    return F.when((e > 0.8) & (F.length(c) < 50), 0.9).when((e > 0.6) & (ratio < 0.3) & (F.size(words) < 30), 0.8).otherwise(e * 0.5)


def write_importance(c: Column, importance: Column, tags: Column) -> Column:
    n = F.length(c)
    sized = F.when(n < 20, importance * 0.5).when(n > 100, importance * 1.2).otherwise(importance)
    tagged = 1.0 + F.size(F.array_intersect(tags, F.array(*map(F.lit, HIGH_VALUE_TAGS)))) * 0.15
    signals = 1.0 + F.least(F.lit(0.5), count_contained(F.lower(c), SUBSTANCE) * 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sized * tagged * signals))


def gate(c: Column, importance: Column, valence: Column, tags: Column) -> Column:
    """The write gate's decision without its similarity check: accept, reject or defer, with a reason."""
    t = F.trim(c)
    score = write_importance(t, importance, tags)
    return (
        F.when(c.isNull() | (t == ""), "reject:empty_text").when(F.length(t) < 8, "reject:too_short").when(noise(t) > 0.7, "reject:noise_pattern")
        .when(emotional_noise(t, valence) > 0.85, "defer:emotional_noise").when(score < 0.05, "reject:too_low_importance")
        .when(score < 0.15, "defer:low_importance").otherwise("accept:passed")
    )


def causal_vote(c: Column) -> tuple[Column, Column]:
    """The relation most wordings of a text speak for and its confidence; causes and 0.1 without any."""
    low = F.lower(c)
    scores = {k: sum((F.when(low.rlike(p), 1).otherwise(0) for p in ps), F.lit(0)) for k, ps in CAUSAL.items()}
    most = F.greatest(*scores.values())
    kind = None
    for k, s in scores.items():
        kind = F.when(s == most, k) if kind is None else kind.when(s == most, k)
    return kind, F.when(most == 0, 0.1).otherwise(F.least(F.lit(0.9), 0.3 + most * 0.15))


def fact(c: Column) -> Column:
    """The one fact a text states by the first wording that applies: struct(subject, predicate, kind, confidence)."""
    low = F.lower(c)
    names = F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: x.rlike("^[A-Z][a-z]+$"))
    make = lambda s, p, k, f: F.struct(s.alias("subject"), p.alias("predicate"), F.lit(k).alias("kind"), F.lit(f).alias("confidence"))
    any_of = lambda words: count_contained(low, words) > 0
    changed = F.lit(None).cast("string")
    for w in reversed(CHANGE):
        changed = F.when(F.contains(low, F.lit(w)), F.lit(w)).otherwise(changed)
    return (
        F.when(any_of(PREFERENCE), make(F.lit("User"), F.lit("prefers"), "preference", 0.6))
        .when(changed.isNotNull(), make(F.lit("System"), changed, "event", 0.65))
        .when(any_of(OUTCOME), make(F.lit("System"), F.lit("resulted_in"), "event", 0.55))
        .when(F.size(names) >= 2, make(F.try_element_at(names, F.lit(1)), F.lit("met_with"), "relationship", 0.5))
    )


def memory_type() -> Column:
    """working, procedural, semantic or episodic, from tags, state and vector."""
    has = lambda *ws: F.arrays_overlap("tags", F.array(*map(F.lit, ws)))
    c = F.col
    return (
        F.when(F.array_contains("tags", "working"), "working")
        .when((c("state") == "active") & (c("replay_count") == 0) & (c("stability") < 0.2) & (F.size("tags") == 0), "working")
        .when(has("preference", "style", "habit", "convention", "pattern", "workflow", "rule") | (c("replay_count") >= 4) | (c("hippocampal_dependency") < 0.4), "procedural")
        .when(has("fact", "knowledge", "tech-stack", "config", "setup", "infra", "architecture", "definition", "reference") | (c("stability") > 0.4) | c("schema_ref").isNotNull(), "semantic")
        .otherwise("episodic")
    )
