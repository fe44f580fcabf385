"""Text functions as Column expressions (JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
DONE_WORDS = ("x", "✓", "đã", "ok", "done", "hoàn thành", "true", "1", "yes", "completed", "xong", "finish", "100%", "hoan thanh")
NOT_STARTED_WORDS = ("", "0", "none", "nan", "pending", "todo", "to do", "not started", "chưa", "chua", "false", "no")
PROGRESS_PARTS = ("doing", "in progress", "progress", "đang làm", "dang lam", "wip", "processing")
DONE_PARTS = ("done", "hoàn thành", "hoan thanh", "completed", "complete", "finished", "xong", "100%", "ok", "check", "✓")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DONE_PHRASES = ("done", "hoàn thành", "hoan thanh", "completed", "xong", "100%")
LEGACY_STATUS = {
    "Not Started": ("todo", "to do", "backlog", "open", "new", "planned", "pending", "not started", "ns"),
    "In Progress": ("doing", "in progress", "ip", "working", "wip", "progress"),
    "Completed": ("done", "closed", "resolved", "finished", "complete", "completed", "merged"),
}
EFFORT_WORDS = ("api", "integration", "backend", "database", "complex", "research", "prototype", "design", "kubernetes", "refactor", "migration", "security", "ml", "nlp")
SKILL_TAGS: dict[str, tuple[str, ...]] = {
    "Backend": ("backend", "api", "rest", "graphql", "database", "sql", "java", "spring", "python", "django", "node", "express"),
    "Frontend": ("frontend", "react", "vue", "angular", "ui", "ux", "javascript", "html", "css", "tailwind"),
    "Mobile": ("android", "ios", "swift", "kotlin", "react native", "flutter"),
    "DevOps": ("devops", "docker", "kubernetes", "k8s", "terraform", "ci/cd", "aws", "gcp", "azure", "monitoring", "logging"),
    "Data/ML": ("data", "etl", "warehouse", "ml", "ai", "pytorch", "tensorflow", "xgboost", "lightgbm", "nlp", "cv"),
    "Design": ("design", "figma", "wireframe", "prototype", "ux research", "visual"),
    "PM": ("scrum", "kanban", "sprint", "gantt", "evm", "estimate", "risk", "roadmap", "stakeholder", "okr"),
    "Soft": ("communication", "leadership", "presentation", "negotiation", "collaboration", "problem solving", "critical thinking"),
}


def clean(c: Column) -> Column:
    """Trimmed, white space of every kind (no-break spaces too) collapsed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _any(s: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(p) for p in parts])


def to_number(c: Column) -> Column:
    """Decimal comma read as a point; what can't be read, and NaN, is null."""
    d = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(d), d)


def is_tasky(c: Column) -> Column:
    """A task text: has a letter, is no number and no weekday."""
    s = clean(c)
    return s.rlike("[A-Za-zÀ-ỹ]") & ~F.lower(s).isin(*WEEKDAYS)


def detect_done(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return s.isin(*DONE_WORDS) | _any(s, DONE_PHRASES)


def status_value(c: Column) -> Column:
    """Three states: empty-like words, then parts of progress, then parts of done, else In Progress."""
    s = F.lower(clean(c))
    return F.when(s.isin(*NOT_STARTED_WORDS), "Not Started").when(_any(s, PROGRESS_PARTS), "In Progress").when(_any(s, DONE_PARTS), "Completed").otherwise("In Progress")


def legacy_status(c: Column) -> Column:
    """Three states by whole words, in order; else In Progress."""
    s = F.lower(F.trim(F.coalesce(c, F.lit("nan"))))
    out = None
    for state, words in LEGACY_STATUS.items():
        hit = s.rlike(r"\b(?:" + "|".join(words) + r")\b")
        out = F.when(hit, state) if out is None else out.when(hit, state)
    return out.otherwise("In Progress")


def collapsed_status(df: DataFrame, column: str) -> DataFrame:
    """df with the column as legacy states; with fewer than three of them in all, Not Started becomes In Progress."""
    d = df.withColumn(column, legacy_status(F.col(column)))
    n = d.agg(F.count_distinct(column).alias("__n"))
    return d.join(F.broadcast(n)).withColumn(column, F.when((F.col("__n") < 3) & (F.col(column) == "Not Started"), "In Progress").otherwise(F.col(column))).drop("__n")


def split_people(c: Column, signs: str = r"[+;,/|&]+") -> Column:
    """Parts between runs of signs, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(clean(c), signs), lambda x: F.trim(x)), lambda x: x != "")


def list_of(c: Column) -> Column:
    """A packed list: JSON where it begins with '[' (unreadable: empty), else split at signs."""
    s = F.trim(F.coalesce(c, F.lit("")))
    as_json = F.coalesce(F.from_json(s, "array<string>", {"allowSingleQuotes": "false"}), F.array().cast("array<string>"))
    return F.when(s.startswith("["), as_json).otherwise(split_people(c))


def first_of(c: Column) -> Column:
    return F.coalesce(F.try_element_at(list_of(c), F.lit(1)), F.lit(""))


def dependencies(c: Column) -> Column:
    """Task ids in a text: separators and blanks split it."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[;,|/]+", " "), r"\s+"), lambda x: x != "")


def effort_estimate(c: Column) -> Column:
    """1 to 10: a sixth of the number of words, 0.8 more for each keyword contained."""
    t = F.lower(F.coalesce(c, F.lit("")))
    words = F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != ""))
    hits = reduce(lambda a, b: a + b, [t.contains(k).cast("int") for k in EFFORT_WORDS])
    base = F.greatest(F.lit(1.0), F.least(F.lit(10.0), words / 6.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), base + 0.8 * hits))


def skill_tags(c: Column, lexicon: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Sorted tags of the lexicon whose terms stand between blanks in the text."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "), F.lit(" "))
    tags = [F.when(_any(t, tuple(f" {w} " for w in words)), tag) for tag, words in (lexicon or SKILL_TAGS).items()]
    return F.array_sort(F.array_compact(F.array(*tags)))


def infer_skills(c: Column, lexicon: dict[str, tuple[str, ...]], bonuses: list[tuple[Column, str, float]] | None = None, top: int = 4) -> Column:
    """The top labels by the number of hits of their patterns and given bonuses; ties in lexicon order; none: General."""
    t = F.lower(clean(c))
    scores = []
    for i, (label, patterns) in enumerate(lexicon.items()):
        hits = reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit("(?iu)" + p)) for p in patterns]).cast("double")
        for when, name, plus in bonuses or []:
            if name == label:
                hits = hits + F.when(when, plus).otherwise(0.0)
        scores.append(F.struct((-hits).alias("s"), F.lit(i).alias("i"), F.lit(label).alias("label")))
    ranked = F.filter(F.array_sort(F.array(*scores)), lambda x: x["s"] < 0)
    return F.when(F.size(ranked) > 0, F.transform(F.slice(ranked, 1, top), lambda x: x["label"])).otherwise(F.array(F.lit("General")))


# Patterns of the skill labels, English and Vietnamese.
SKILL_PATTERNS: dict[str, tuple[str, ...]] = {
    "Frontend": (
        r"\breact\b", r"next\.?js", r"\bvue\b", r"\bangular\b", r"\bsvelte\b", r"\b(ui|ux)\b", r"\binterface\b", r"\bcomponent(s)?\b", r"\b(css|html|tailwind|responsive|accessibility|aria|storybook)\b",
        r"\bwireframe\b", r"\bprototype\b", r"\bfigma\b", r"\bsketch\b", r"giao ?di[eê]n", r"m[aà]n h[iì]nh", r"thi[eế]t k[eế] ui", r"\bfrontend\b",
    ),
    "Backend": (
        r"\b(api|rest|graphql|grpc|websocket|service|microservice)\b", r"\b(database|db|postgres|mysql|sqlserver|sqlite|nosql|mongodb|redis|cache|orm)\b",
        r"\b(django|flask|fastapi|spring|laravel|nest\.?js|node\.?js|express)\b", r"\b(python|java|golang|go|\.net|c#|rust)\b", r"k[eê]t ?n[ôo]i", r"t[íi]ch ?h[ợơ]p", r"x[âa]y d[ựu]ng api",
    ),
    "DevOps": (
        r"\b(deploy|deployment|release|ci/cd|pipeline|jenkins|github actions|gitlab ci)\b", r"\b(docker|kubernetes|k8s|helm|terraform|ansible)\b", r"\b(cloud|aws|azure|gcp|s3|ec2|eks)\b",
        r"\b(monitor|observability|prometheus|grafana|logging|elastic|elk)\b", r"h[ạa] t[ầa]ng", r"tri[eể]n khai", r"v[ậa]n h[àa]nh", r"m[ôo]i tr[uư]ờng",
    ),
    "Security": (r"\b(security|auth|oauth|jwt|sso|acl|rbac|iam|tls|cert)\b", r"\b(pentest|owasp|xss|csrf|sql injection)\b", r"b[aả]o m[ậa]t", r"quy[eề]n truy c[ậa]p", r"x[aá]c th[ựu]c", r"m[ãa] h[óo]a"),
    "Data/AI": (
        r"\b(data|analytics|etl|elt|airflow|dbt|warehouse|lake|bigquery|snowflake|hive|spark|pandas|numpy)\b",
        r"\b(ml|machine learning|deep learning|model|training|inference|sklearn|xgboost|lightgbm|transformer|llm|embedding|prompt|rag)\b", r"\b(ab[\s\-]?test|experiment[s]?)\b",
        r"ph[âa]n t[íi]ch d[ữu] li[ệe]u", r"th[íi] ngh[ii]em", r"tr[íi] tu[ệe] nh[âa]n t[ạa]o",
    ),
    "Testing/QA": (r"\b(test|unit|integration|e2e|selenium|pytest|jest|cypress|coverage)\b", r"\b(benchmark|stress|load|perf(ormance)?)\b", r"ki[eể]m th[uử]", r"th[uử] nghi[eệ]m"),
    "Design": (
        r"\b(design|ux|ui|prototype|wireframe|usability|figma|sketch|illustrator|photoshop|branding|styleguide|typography|layout)\b", r"thi[eế]t k[eế]", r"tr[ảa]i nghi[eẹ]m ng[ưư]ời d[ùu]ng",
    ),
    "Product/PM": (
        r"\b(product|roadmap|backlog|grooming|sprint|plan(ning)?|estimate|story point|user story|acceptance criteria)\b",
        r"\b(okrs?|kpi|stakeholder|timeline|scope|strategy|business|market|pricing|go(\s|-)to(\s|-)market)\b", r"\b(requirement|brd|prd)\b",
        r"qu[ảa]n l[ýy] d[ựu] [áa]n", r"ph[âa]n t[íi]ch th[ịi] tr[ưư]ờng", r"nghi[êe]n c[ứu]", r"k[ếe] ho[ạa]ch",
    ),
    "Mobile": (
        r"\bmobile\b", r"\bandroid\b", r"\bios\b", r"react native", r"\bflutter\b", r"\bkotlin\b", r"\bswift\b", r"\bxcode\b", r"\bplay console\b", r"\bapp store\b", r"\bapk\b", r"\bipa\b", r"ứng d[ụu]ng di d[ộo]ng",
    ),
    "General": (r"\b(doc|documentation|meeting|support|bug|fix|refactor|cleanup|research)\b", r"h[oọ]p", r"ghi ch[uú]"),
}


# Words that lift a label beside another one, and by how much.
SKILL_TRIGGERS: dict[str, tuple[tuple[str, ...], float]] = {
    "serves": (("api", "service", "backend"), 0.5),
    "ships": (("deploy", "docker", "k8s", "triển khai", "trien khai"), 0.5),
    "trial": (("ab test", "ab-test", "experiment", "thí nghiệm", "thi nghiem"), 0.5),
    "guards": (("bảo mật", "bao mat", "security", "auth", "jwt", "sso"), 0.75),
}


def task_skills(c: Column) -> Column:
    """infer_skills with the default patterns and bonuses for labels that go together."""
    t = F.lower(clean(c))
    label_hit = lambda label: reduce(lambda a, b: a | b, [t.rlike("(?iu)" + p) for p in SKILL_PATTERNS[label]])
    named = {k: _any(t, words) for k, (words, _) in SKILL_TRIGGERS.items()}
    plus = {k: w for k, (_, w) in SKILL_TRIGGERS.items()}
    served = label_hit("Frontend") & named["serves"]
    return infer_skills(c, SKILL_PATTERNS, [
        (served, "Backend", plus["serves"]), ((label_hit("Backend") | served) & named["ships"], "DevOps", plus["ships"]), (named["trial"], "Data/AI", plus["trial"]),
        (named["trial"], "Product/PM", plus["trial"]), (named["guards"], "Security", plus["guards"]),
    ])


RANGE = 1 << 16  # row numbers in one range of a global fill


def week_numbers(df: DataFrame, week: str, order: str) -> DataFrame:
    """df with week_no >= 1: weeks filled forward in row order; a column without any positive number gives 1..n.

    The order of rows is global, so gaps are filled in two steps: within ranges of RANGE row numbers,
    then across the ranges' last values, one row a range; a task never holds more than a range."""
    n = to_number(F.col(week).cast("string"))
    d = df.withColumn("__w", n)
    flags = d.agg(F.max("__w").alias("__most"))
    d = d.join(F.broadcast(flags)).withColumn("__part", F.floor(F.col(order) / RANGE))
    inner = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = d.groupBy("__part").agg(F.max_by("__w", F.when(F.col("__w").isNotNull(), F.col(order))).alias("__last"), F.count(F.lit(1)).alias("__k"))
    run = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("__part", F.last("__last", ignorenulls=True).over(run).alias("__before"), F.coalesce(F.sum("__k").over(run), F.lit(0)).alias("__base"))
    j = d.withColumns({"__own": F.last("__w", ignorenulls=True).over(inner), "__rn": F.count(F.lit(1)).over(inner)}).join(ends, "__part")
    filled = F.greatest(F.coalesce("__own", "__before", F.lit(1.0)).cast("int"), F.lit(1))
    no = F.when(F.coalesce(F.col("__most"), F.lit(0.0)) > 0, filled).otherwise((F.col("__base") + F.col("__rn")).cast("int"))
    return j.withColumn("week_no", no).select(*df.columns, "week_no")


def fill_forward(df: DataFrame, column: str, order: str) -> DataFrame:
    """column with gaps filled by the last value before, in row order; first within ranges, then over the ranges' last values."""
    d = df.withColumn("__part", F.floor(F.col(order) / RANGE))
    ends = d.groupBy("__part").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("__last"))
    ends = ends.select("__part", F.last("__last", ignorenulls=True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inner = F.last(column, ignorenulls=True).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn("__own", inner).join(ends, "__part").withColumn(column, F.coalesce("__own", "__before")).select(*df.columns)


def first_seen_rank(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, rank): distinct values numbered by their first row."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first_row"))
    return first.select(value, F.row_number().over(W.orderBy("first_row", value)).cast("long").alias("rank"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order. An aggregation, not a window: hot keys combine map-side."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("__r")).select("__r.*")
