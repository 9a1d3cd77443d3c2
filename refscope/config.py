"""Settings a caller passes to an analysis; plain values on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Simplifier:
    type: str
    enabled: bool = True
    priority: int = 1


@dataclass(frozen=True)
class Comparison:
    type: str = "LevenshteinDistanceComparison"
    enabled: bool = True
    priority: int = 1
    max_distance: int = 10
    threshold: float = 0.8


@dataclass(frozen=True)
class SimilarityConfig:
    enabled: bool = False
    simplifiers: tuple[Simplifier, ...] = ()
    comparisons: tuple[Comparison, ...] = ()

    def active_simplifiers(self) -> list[Simplifier]:
        return sorted((s for s in self.simplifiers if s.enabled), key=lambda s: s.priority)

    def active_comparisons(self) -> list[Comparison]:
        from refscope.functions.distance import COMPARISONS

        return sorted((c for c in self.comparisons if c.enabled and c.type in COMPARISONS), key=lambda c: c.priority)

    def by_distance_only(self) -> bool:
        """Whether candidates may be looked up by the texts' grams."""
        return all(c.type == "LevenshteinDistanceComparison" for c in self.active_comparisons())

    def describe(self) -> str:
        """Stable text of everything that can change a result; part of the fingerprint."""
        if not self.enabled:
            return "off"
        steps = [s.type for s in self.active_simplifiers()]
        rules = [f"{c.type}({c.max_distance},{c.threshold!r})" for c in self.active_comparisons()]
        return ">".join(steps) + "~" + ",".join(rules)

    @staticmethod
    def from_settings(section: dict) -> "SimilarityConfig":
        """Read a ``CodeSimilarity`` settings section (Pascal-case keys)."""
        simplifiers = tuple(
            Simplifier(s.get("Type", ""), s.get("Enabled", True), s.get("Priority", 1))
            for s in section.get("Simplifiers") or []
        )
        comparisons = []
        for c in section.get("Comparisons") or []:
            limits = c.get("Settings") or {}
            comparisons.append(
                Comparison(
                    c.get("Type", ""),
                    c.get("Enabled", True),
                    c.get("Priority", 1),
                    limits.get("MaxDistance", 10),
                    limits.get("ThresholdPercent", 0.8),
                )
            )
        return SimilarityConfig(section.get("Enabled", False), simplifiers, tuple(comparisons))


# The settings shipped with the command-line tool.
SHIPPED_SIMILARITY = SimilarityConfig(
    enabled=True,
    simplifiers=(Simplifier("WhitespaceNormalizer", True, 1), Simplifier("CommentRemover", True, 2)),
    comparisons=(Comparison(max_distance=3, threshold=0.9),),
)

# Whitespace first turns a multi-line snippet into one line, so one "//" then
# removes the rest of it. This preset removes comments while lines still exist.
COMMENTS_FIRST_SIMILARITY = SimilarityConfig(
    enabled=True,
    simplifiers=(Simplifier("CommentRemover", True, 1), Simplifier("WhitespaceNormalizer", True, 2)),
    comparisons=(Comparison(max_distance=3, threshold=0.9),),
)

# The usage types included by the shipped settings.
SHIPPED_USAGE_TYPES = [
    "MethodInvocation",
    "PropertyAccess",
    "TypeReference",
    "FieldAccess",
    "ParameterType",
    "Attribute",
    "Direct",
    "VariableDeclaration",
    "GenericTypeArgument",
]


@dataclass(frozen=True)
class AnalysisOptions:
    """Options of one run. ``usage_types`` (explicit) wins over ``configured_usage_types``."""

    context_lines: int = 0
    usage_types: list[str] | None = None
    configured_usage_types: list[str] = field(default_factory=list)
    similarity: SimilarityConfig = SimilarityConfig()
    strict_paths: bool = False
    match_member: bool = False
