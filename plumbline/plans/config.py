"""What a user states about a dataset before it is evaluated."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from plumbline.operators.currentness import LONG_YEARS, SHORT_YEARS
from plumbline.plans.catalogue import CHARACTERISTICS
from plumbline.sources.rules import SemanticRule, SyntacticRule

DEFAULT_PRIORITY = 2
DEFAULT_THRESHOLD = 90.0


@dataclass(frozen=True)
class UsageContext:
    """What the data is for."""

    domain: str = ""
    purpose: str = ""
    task_type: str = ""
    standards: tuple[str, ...] = ()
    notes: str = ""


@dataclass(frozen=True)
class Subjects:
    """Whom the quality of the data affects."""

    entities: tuple[str, ...] = ()
    stakeholders: tuple[str, ...] = ()


@dataclass(frozen=True)
class ExpectedRange:
    """Where the values of a column are credible."""

    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class EvaluationConfig:
    """Everything an evaluation needs beside the table.

    ``as_of_year`` fixes what "now" is, so that results can be repeated.
    ``thresholds`` gives the pass mark per dimension.  ``order_by`` states the
    row order for time-series components; without it they are not scored.
    """

    dataset_name: str = "dataset"
    as_of_year: int | None = None
    context: UsageContext = UsageContext()
    subjects: Subjects = Subjects()
    syntactic_rules: Sequence[SyntacticRule] = ()
    semantic_rules: Sequence[SemanticRule] = ()
    metadata: Mapping[str, str] = field(default_factory=dict)
    label_col: str | None = None
    unlabeled_values: Sequence = ()
    expected_classes: int | None = None
    expected_ranges: Sequence[ExpectedRange] = ()
    dictionary: Mapping[str, str] = field(default_factory=dict)
    order_by: Sequence[str] = ()
    datetime_by: str = "name"
    event_time: str | None = None
    short_years: int = SHORT_YEARS
    long_years: int = LONG_YEARS
    skewness_limit: float = 2.0
    kurtosis_limit: float = 7.0
    thresholds: Mapping[str, float] = field(default_factory=dict)
    default_threshold: float = DEFAULT_THRESHOLD
    auto_priorities: Mapping[str, int] = field(default_factory=dict)
    priorities: Mapping[str, int] = field(default_factory=dict)

    def priority(self, characteristic: str) -> int:
        """The user's priority, else the suggested one, else the default."""
        return self.priorities.get(
            characteristic, self.auto_priorities.get(characteristic, DEFAULT_PRIORITY)
        )


def parse_priorities(text: str) -> dict[str, int]:
    """Priorities from ``accuracy=1,diversity=2``; unknown parts give a warning."""
    found = {}
    for part in text.split(","):
        name, _, value = (p.strip() for p in part.partition("="))
        if name in CHARACTERISTICS and value.lstrip("+-").isdigit():
            found[name] = int(value)
        elif part.strip():
            warnings.warn(f"unknown priority ignored: {part.strip()!r}", stacklevel=2)
    return found
