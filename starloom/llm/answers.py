"""Defective prompt and response pairs: empty, truncated, refusal, copied question, other language.

Each answer is split into a statement and the prose around it. A suffix automaton of the prompt measures how much of the prose copies it; an
automaton of refusal phrases finds refusals; delimiter stacks, last words and unknown names find statements that break off; stopwords
vote on the language of prompt and prose. A statement can also stop where the grammar would let it end: masked statements of the
whole corpus are counted by prefix, and one whose form nearly always goes on (its end share is below `end_share`) breaks off.

Defined results: a pair has one defect at most, the first that applies of empty, truncated (statement), copied question, refusal, truncated (prose),
other language; a null or empty prompt is never copied from and has no language; texts are read whole; of rows given twice under one id
the first run counts; rows without an id are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.sizes import broadcast_if_small, by_key
from starloom.lineage import cut
from starloom.llm.automata import SuffixAutomaton, covered
from starloom.llm.languages import Languages, plain
from starloom.llm.skeleton import clean
from starloom.llm.sqltext import Statement, prefix_hashes, read, split_answer

#: Phrases by which answers decline, by language, in plain form.
REFUSALS = {
    "English": [
        "can't help with", "cannot help with", "can't assist", "cannot assist", "won't be able to", "will not be able to", "not able to help", "unable to", "cannot comply", "can't comply", "must decline",
        "have to decline", "i decline", "rather not answer", "would not be appropriate", "not something i can do", "request refused", "not allowed to", "permitted to answer", "no query can be given",
        "not enough schema information", "against my guidelines", "cannot provide", "can't provide", "cannot answer", "can't answer", "i refuse", "do not have access to",
    ],
    "Hindi": ["उत्तर देना मेरे लिए संभव नहीं", "उत्तर देने से मना", "तक पहुँच नहीं है", "सहायता नहीं कर सकता", "सहायता नहीं कर सकती", "मदद नहीं कर सकता", "मदद नहीं कर सकती", "जवाब नहीं दे सकता"],
    "Marathi": ["उत्तर देणे मला शक्य नाही", "उत्तर देण्यास नकार", "माझी पोहोच नाही", "मदत करू शकत नाही", "उत्तर देऊ शकत नाही"],
    "Bengali": ["উত্তর দেওয়া আমার পক্ষে সম্ভব নয়", "উত্তর দিতে অস্বীকার", "আমার প্রবেশাধিকার নেই", "সাহায্য করতে পারছি না", "সাহায্য করতে পারব না", "উত্তর দিতে পারছি না"],
    "Tamil": ["பதிலளிக்க எனக்கு அனுமதி இல்லை", "விடையளிக்க மறுக்கிறேன்", "அணுக எனக்கு வழியில்லை", "என்னால் உதவ முடியாது", "பதிலளிக்க முடியாது"],
    "Telugu": ["సమాధానం ఇవ్వడం నాకు సాధ్యం కాదు", "జవాబు ఇవ్వడానికి నిరాకరిస్తున్నాను", "నాకు ప్రవేశం లేదు", "నేను సహాయం చేయలేను", "సమాధానం ఇవ్వలేను"],
    "Hinglish": ["mere liye possible nahi", "jawab dene se mana", "ka access nahi hai", "madad nahi kar sakta", "madad nahi kar sakti", "jawab nahi de sakta"],
}
ENDS = ".।॥?!…"
COPIED = 0.85


class Votes:
    """Stopword votes: the most frequent words of each language's labelled text, by the log of their relative frequency."""

    def __init__(self, samples: dict[str, list[str]], top: int = 300) -> None:
        counts = {name: Counter(w for t in texts for w in self.words(plain(t))) for name, texts in sorted(samples.items())}
        totals = {name: sum(c.values()) or 1 for name, c in counts.items()}
        self.names = list(counts)
        self.weights: dict[str, list[float]] = {}
        for word in {w for c in counts.values() for w, _ in c.most_common(top)}:
            shares = [counts[n][word] / totals[n] + 2e-4 for n in self.names]
            self.weights[word] = [math.log(s * len(shares) / sum(shares)) for s in shares]
        letters = {n: Counter(Languages.script(ch) for t in texts for ch in t if ch.isalpha()) for n, texts in samples.items()}
        self.home = {n: c.most_common(1)[0][0] if c else 0 for n, c in letters.items()}

    @staticmethod
    def words(text: str) -> list[str]:
        return [w for w in re.split(r"[^\wऀ-෿]+", text) if w and not w[0].isdigit()]

    def best(self, text: str) -> tuple[str | None, float]:
        """Language and its lead over the next in votes; (None, 0) if nothing votes."""
        score, voted = dict.fromkeys(self.names, 0.0), False
        for w in self.words(plain(text)):
            script = Languages.script(w[0])
            known = self.weights.get(w)
            for i, n in enumerate(self.names):
                if known:
                    score[n] += known[i]
                # a word in a script that isn't the language's own speaks against it; names in Latin letters occur anywhere
                if script != self.home[n]:
                    score[n] -= 2.0 if script else 0.3
            voted = True
        if not voted:
            return None, 0.0
        first, second = sorted(self.names, key=lambda n: (-score[n], n))[:2]
        return first, score[first] - score[second]


def learn(records: DataFrame, language: str, question: str, raw: str, predicted: str, samples: dict[str, list[str]], most_prompts: int = 4000, most_prose: int = 4000) -> dict[str, list[str]]:
    """`samples`, prompts with their label, and prose of answers, by which votes know the words of answers.

    At most `most_prompts` labelled prompts and `most_prose` answers (the first by the hash of their text) are looked at, which bounds what is fitted and nothing else.
    An answer's prose is kept only if the samples and prompts alone say that it is in its prompt's language, so an answer in another language teaches nothing.
    """
    known = records.filter(F.col(language).isin(list(samples))).select(F.col(language).alias("l"), F.col(question).alias("q"), F.col(raw).alias("r"), F.length(F.coalesce(predicted, F.lit(""))).alias("n"))
    out = {name: list(texts) for name, texts in samples.items()}
    for row in known.filter("q is not null").select("l", "q").distinct().orderBy(F.xxhash64("q"), "l").limit(most_prompts).collect():
        out[row["l"]].append(row["q"])
    votes, spoken = Votes(out), known.filter((F.col("n") > 20) & (F.length("r") >= F.col("n") + 30))
    for row in spoken.select("l", "r").distinct().orderBy(F.xxhash64("r"), "l").limit(most_prose).collect():
        prose = split_answer(row["r"])[1]
        if prose and votes.best(prose)[0] == row["l"]:
            out[row["l"]].append(prose)
    return out


class Judge:
    def __init__(self, samples: dict[str, list[str]], columns: list[str], tables: list[str]) -> None:
        self.votes = Votes(samples)
        self.forms: dict[str, tuple[Statement, list[int]]] = {}
        self.columns, self.tables = frozenset(c.lower() for c in columns), frozenset(t.lower() for t in tables)
        try:
            import ahocorasick

            self.refusals = ahocorasick.Automaton()
            for phrase in (p for phrases in REFUSALS.values() for p in phrases):
                self.refusals.add_word(plain(phrase), 1)
            self.refusals.make_automaton()
        except ImportError:
            self.refusals = None

    def refuses(self, prose: str) -> bool:
        text = plain(prose).replace("’", "'")
        if self.refusals is None:
            return any(plain(p) in text for phrases in REFUSALS.values() for p in phrases)
        return next(self.refusals.iter(text), None) is not None

    def copied(self, question: str, prose: str) -> float:
        """Share of the prose's letters and digits that lie in matches of five or more with the prompt."""
        prompt, answer = ("".join(ch for ch in plain_digits(x) if ch.isalnum() or "ऀ" <= ch <= "෿") for x in (question, prose))
        if not prompt or not answer:
            return 0.0
        least = min(5, len(prompt))
        return covered(SuffixAutomaton(prompt).matches(answer), least) / len(answer)

    def cut_number(self, tokens: list[str], question: str) -> bool:
        """The statement ends in a comparison with the first digits of a number that the prompt names."""
        if len(tokens) < 2 or not tokens[-1].isdigit() or tokens[-2] not in ("<", ">", "<=", ">=", "=", "<>"):
            return False
        named = {re.sub(r"\D", "", x) for x in re.findall(r"\d[\d,]*", plain_digits(question))}
        return tokens[-1] not in named and any(x.startswith(tokens[-1]) for x in named)

    def form(self, statement: str) -> tuple[Statement, list[int]]:
        """A statement's tokens and the hashes of its beginnings; prediction and answer mostly hold the same one."""
        if statement not in self.forms:
            if len(self.forms) >= 256:
                self.forms.clear()
            s = read(statement, self.columns, self.tables)
            self.forms[statement] = s, prefix_hashes(s.skeleton)
        return self.forms[statement]

    def judge(self, question: str | None, raw: str | None, predicted: str | None) -> dict:
        question, raw, predicted = question or "", raw or "", predicted or ""
        statement, prose = split_answer(raw)
        other, _ = split_answer(predicted)
        out = {"defect": None, "raw_form": None, "other_form": None}
        body = re.sub(r"```\w*|(?i:^\s*sql\s*:)", " ", raw)
        if statement is None and not any(ch.isalnum() for ch in body):
            return out | {"defect": "empty"}
        forms = []
        for name, text in (("raw_form", statement), ("other_form", other)):
            if text:
                s, hashes = self.form(text)
                if s.broken or self.cut_number(s.tokens, question):
                    return out | {"defect": "truncated"}
                forms.append([t.lower() for t in s.tokens])
                out[name] = hashes
        if len(forms) == 2 and forms[0] != forms[1]:
            short, long = sorted(forms, key=lambda x: len("".join(x)))
            if short and len("".join(short)) < len("".join(long)) and "".join(long).startswith("".join(short)):
                return out | {"defect": "truncated"}
        spoken = [ch for ch in prose if ch.isalpha()]
        if statement is None:
            if self.copied(question, re.sub(r"^\s*(question|q)\s*:", "", prose, flags=re.I)) >= COPIED:
                return out | {"defect": "copied_question"}
            if self.refuses(prose):
                return out | {"defect": "refusal"}
            if spoken and prose.rstrip(" \t\n\"'”)]*`")[-1:] not in ENDS:
                return out | {"defect": "truncated"}
        elif not other:
            out["defect"] = "empty"
        if not out["defect"] and len(spoken) >= 8:
            asked, told = self.votes.best(question), self.votes.best(prose)
            if asked[0] and told[0] and asked[0] != told[0] and told[1] > 1.0:
                out["defect"] = "other_language"
        return out


def plain_digits(text: str) -> str:
    return clean(text).lower()


def judge(df: DataFrame, id_col: str, question: str, raw: str, predicted: str, run: str, samples: dict[str, list[str]], schema: DataFrame, end_share: float = 0.2, least_support: int = 20) -> DataFrame:
    """(`id`, `defect`) of every defective pair. `schema` has columns table_name and column_name; its names are shared with the tasks only below 200,000."""
    spark = df.sparkSession
    names = schema.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct().limit(200_001).collect()
    if len(names) > 200_000:
        raise ValueError("more than 200,000 schema columns")
    shared = spark.sparkContext.broadcast((samples, sorted({r.c for r in names if r.c}), sorted({r.t for r in names if r.t})))
    rows = by_key(df.filter(F.col(id_col).isNotNull()), id_col).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(run).alias("_t"), F.col(question).alias("q"), F.col(raw).alias("r"), F.col(predicted).alias("p"))).alias("x")).select("id", "x.q", "x.r", "x.p")
    kind = rows.schema["id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge_ = Judge(*shared.value)
        for frame in frames:
            found = [judge_.judge(q, r, p) for q, r, p in zip(frame["q"], frame["r"], frame["p"])]
            yield pd.DataFrame({"id": frame["id"], **{k: [x[k] for x in found] for k in ("defect", "raw_form", "other_form")}})

    seen = cut(rows.mapInPandas(work, f"id {kind}, defect string, raw_form array<bigint>, other_form array<bigint>"))
    # how often each masked statement ends, and how often it goes on, over the statements without a fault of their own
    forms = seen.filter("defect is null or defect = 'other_language'").select(F.explode(F.array("raw_form", "other_form")).alias("form")).filter("form is not null")
    counted = forms.groupBy(F.element_at("form", -1).alias("whole")).agg(F.count("*").alias("ends"), F.first("form").alias("form"))
    prefixes = counted.select("ends", F.explode("form").alias("prefix")).groupBy("prefix").agg(F.sum("ends").alias("upto"))
    stops = counted.join(prefixes, F.col("whole") == F.col("prefix")).filter((F.col("upto") >= least_support) & (F.col("ends") < end_share * F.col("upto"))).select("whole")
    stops = broadcast_if_small(cut(stops))
    last = seen.select("id", "defect", F.explode(F.array(F.element_at("raw_form", -1), F.element_at("other_form", -1))).alias("whole")).filter("whole is not null")
    early = last.join(stops, "whole", "left_semi").select("id").distinct().withColumn("early", F.lit(True))
    out = seen.select("id", "defect").join(early, "id", "left")
    defect = F.when(F.col("early") & (F.col("defect").isNull() | F.col("defect").isin("other_language", "empty")), "truncated").otherwise(F.col("defect"))
    return out.select("id", defect.alias("defect")).filter("defect is not null")
