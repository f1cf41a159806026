"""Rule packs: ordered (label, pattern) lists that become column expressions.

A pack is data on the driver and a set of literal patterns in the plan, so each
pattern is compiled once per task and the predicates stay next to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import dispatched, let, matches, phrases, plain_words, quick


def _plain(text: Column) -> Column:
    return plain_words(F.coalesce(text, F.lit("")))


def _tested(text: Column, use) -> Column:
    """``use(test)`` with ``test(rule)`` over a text that is prepared once for all rules of a pack, also where rules are branches.

    A phrase is looked for as plain letters first, which most texts do not have.
    """
    def test(plain: Column, lower: Column, rule: "Rule | str") -> Column:
        found = plain.rlike("(?i)" + quick(rule if isinstance(rule, str) else rule.pattern))
        phrase = None if isinstance(rule, str) else rule.phrase
        return found if phrase is None or not phrase.isascii() else F.contains(lower, F.lit(phrase.lower())) & found

    return let(_plain(text), lambda plain: let(F.lower(plain), lambda lower: use(lambda rule: test(plain, lower, rule))))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    phrase: str | None = None  # the words that the pattern looks for, if it is about some literal words only


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    union: str | None = None  # one pattern that matches whenever any rule does

    @staticmethod
    def of(table: dict[str, str]) -> "RulePack":
        return RulePack(tuple(Rule(k, v) for k, v in table.items()))

    @staticmethod
    def of_phrases(literals: list[str]) -> "RulePack":
        return RulePack(tuple(Rule(x, phrases([x]), x) for x in literals), phrases(literals))

    # -- expressions ------------------------------------------------------
    def first(self, text: Column, default: str | None = None) -> Column:
        """Label of the first rule that matches, in priority order."""
        none = F.lit(default).cast("string")
        label = lambda test: F.coalesce(*[F.when(test(r), F.lit(r.label)) for r in self.rules], none)
        return _tested(text, lambda test: self._if_any(test, label(test), none))

    def all(self, text: Column) -> Column:
        """Labels of all rules that match, in pack order."""
        labels = lambda test: F.array_compact(F.array(*[F.when(test(r), F.lit(r.label)) for r in self.rules]))
        return _tested(text, lambda test: self._if_any(test, labels(test), F.array().cast("array<string>")))

    def hits(self, text: Column) -> Column:
        """map<rule, boolean>."""
        plain, pairs = _plain(text), []
        for r in self.rules:
            pairs += [F.lit(r.label), plain.rlike("(?i)" + quick(r.pattern))]
        return F.create_map(*pairs)

    def asked(self, text: Column, use) -> Column:
        """``use(hit)`` with ``hit(label)`` for single rules, each tested where its branch is reached."""
        rules = {r.label: r for r in self.rules}
        return _tested(text, lambda test: use(lambda label: test(rules[label])))

    def _whole(self) -> str:
        return self.union or "|".join(f"(?:{r.pattern})" for r in self.rules)

    def _if_any(self, test, found: Column, none: Column) -> Column:
        """``found`` where any rule matches: one scan spares most texts the single rules, if all rules make one quick pattern."""
        return found if dispatched(self._whole()) is None else F.when(test(self._whole()), found).otherwise(none)

    def any(self, text: Column) -> Column:
        return matches(text, self._whole())

    def mask(self, text: Column) -> Column:
        """Bit i is set when rule i matches; combine across rows with ``bit_or``."""
        zero = F.lit(0).cast("bigint")

        def bits(test) -> Column:
            out = zero
            for i, r in enumerate(self.rules):
                out = out + F.when(test(r), F.lit(1 << i).cast("bigint")).otherwise(zero)
            return out

        # Most texts match nothing: one combined test spares them the single ones.
        return F.when(self.any(text), _tested(text, bits)).otherwise(zero)

    def labels_of_mask(self, mask: Column) -> Column:
        return F.array_compact(
            F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(r.label)) for i, r in enumerate(self.rules)])
        )


def guess_label(text: Column, pack: RulePack, default: str = "Other") -> Column:
    return pack.first(text, default)


def detect_labels(text: Column, pack: RulePack) -> Column:
    return pack.all(text)


def rule_hits(text: Column, pack: RulePack) -> Column:
    return pack.hits(text)


@dataclass(frozen=True)
class Topic:
    """One story topic: what it is filed under, how much it matters, what to do about it."""

    id: str
    category: str
    importance: int
    pattern: str
    advice: str = ""


@dataclass(frozen=True)
class TopicPack:
    topics: tuple[Topic, ...] = field(default_factory=tuple)

    def verdict(self, title: Column) -> Column:
        """struct(category, importance, topic, advice) of the first topic the title matches."""
        return _tested(title, lambda test: F.coalesce(*[
            F.when(
                test(t.pattern),
                F.struct(
                    F.lit(t.category).alias("category"), F.lit(t.importance).alias("importance"),
                    F.lit(t.id).alias("topic"), F.lit(t.advice).alias("advice"),
                ),
            )
            for t in self.topics
        ]))
