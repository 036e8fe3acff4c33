"""Code maps and labels that differ between survey years.

Years differ by rows of these tables, not by code.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EventRule:
    """How one reused species code is read on one gear."""

    source: str
    label: str
    zero_count: bool = True
    omits_unit: str | None = None
    drops_row: bool = False


@dataclass(frozen=True)
class GearCodes:
    """Everything that depends on how a year's events were coded."""

    pots: str = "POT"
    hooks: str = "HAL"
    target: str = "Sablefish"
    rules: tuple[EventRule, ...] = ()
    large_marker: str | None = None
    not_fish: tuple[str, ...] = field(default=())
    # the size of all pots where no marker tells them apart
    pot_size: str = "Small"
    # escape rings by pot size
    rings: dict[str, str] = field(default_factory=dict)
    # leave out events without a species name where other codes are left out
    drops_undecoded: bool = False

    @property
    def relabel(self) -> dict[str, str]:
        return {r.source: r.label for r in self.rules}

    @property
    def zeroed(self) -> list[str]:
        return [r.label for r in self.rules if r.zero_count]

    @property
    def dropped(self) -> list[str]:
        return [r.label for r in self.rules if r.drops_row]

    @property
    def omitting(self) -> dict[str, str]:
        return {r.label: r.omits_unit for r in self.rules if r.omits_unit}


# Species names reused as event codes, and their meaning on pots.
EARLY_RULES = (
    EventRule("Baited Hook", "Empty Pot"),
    EventRule("Ineffective Hook", "Trap Door Open", omits_unit="trap door open"),
)
LATE_RULES = (
    EventRule("Baited Hook", "Empty pot"),
    EventRule("Ineffective Hook", "Trap door open", omits_unit="Trap door open"),
    EventRule("Alaskan False Jingle", "Lost pot", omits_unit="Lost pot"),
    EventRule("Blackfooted Albatross", "Snarled pot"),
    EventRule(
        "Unsorted sharks",
        "Bait bag lost or damaged",
        omits_unit="Bait bag lost or damaged",
    ),
    EventRule("Shark egg case", "Empty gangion", drops_row=True),
)

# Event labels and invertebrates left out of species composition.
NOT_FISH = (
    "Rougheye/Shortraker Rockfish",
    "Baited Hook",
    "Ineffective Hook",
    "Trap Door Open",
    "Trap door open",
    "Empty Pot",
    "Empty pot",
    "Lost pot",
    "Snarled pot",
    "Bait bag lost or damaged",
    "Empty gangion",
    "Lips or Jaws - Whale Depredation",
    "Brittle Star",
    "Brittle Starfish",
    "Sea Whip",
    "Sea Cucumber",
)

# Events that are not catch in the sample-size table.
NOT_CATCH = (
    "Baited Hook",
    "Empty Pot",
    "Empty pot",
    "Ineffective Hook",
    "Trap Door Open",
    "Trap door open",
    "Lost pot",
    "Snarled pot",
    "Bait bag lost or damaged",
    "Empty gangion",
)

# Depth strata, species sexed on deck, sex codes.
STRATA = {4: "301-400 m", 5: "401-600 m", 6: "601-800 m"}
SEXED_SPECIES = ("Sablefish", "Giant Grenadier", "Spiny Dogfish")
SEX_LABELS = {"M": "Male", "F": "Female", "U": "Unidentified"}

# The species recorded together on deck and told apart by length.
MIXED_LABEL = "Rougheye/Shortraker Rockfish"
MIXED_PARTS = ("Rougheye Rockfish", "Shortraker Rockfish")

# Escape rings by pot size, in the first year and later.
EARLY_RINGS = {
    "Small": "Four 3.5 inch escape rings",
    "Large": "Four modified 4 inch escape rings",
}
LATE_RINGS = {"Small": "None"}

# Labels of the tables.
STUCK = "Stuck in escape ring"
HOOKS = "Hooks"
LARGE_POTS = "Large pots"
SMALL_POTS = "Small pots"
HOOK_AND_LINE = "Hook-and-line"
ALL_SETS = "All_sets_combined"
AVERAGE = "Average"
NONE_MEASURED_OR_CAUGHT = "0 / 0"

EARLY = GearCodes(
    rules=EARLY_RULES, large_marker="Big Skate", not_fish=NOT_FISH, rings=EARLY_RINGS
)
LATE = GearCodes(rules=LATE_RULES, not_fish=NOT_FISH, rings=LATE_RINGS)

# Gear dimensions in inches (diameter, height).
POT_SIZES_INCHES = {"Large": (33.0, 55.0), "Small": (27.0, 50.0)}
METRES_PER_INCH = 0.0254
METRES_PER_FATHOM = 1.8288

# Landing areas in map order, and the survey's species,
# programs, gears left out.
SUBAREAS = ("BS", "AI", "WG", "CG", "WY", "SE")
PROGRAMS = ("IFQ", "CDQ")
LANDED_SPECIES = ("SABL",)
UNUSED_GEARS = ("JIG", "TRW")
POT_CLASS_PREFIX = "POT_"
UNKNOWN_POT = "POT_UNKN"
MIXED_POT = "POT_UNKN_MIXED"
