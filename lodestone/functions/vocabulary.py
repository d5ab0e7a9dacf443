"""Closed vocabularies of the property graph (fixed values)."""

from __future__ import annotations

RELATIONSHIPS = (
    "DECLARES IMPORTS EXPORTS CALLS IMPLEMENTS EXTENDS REFERENCES_TYPE HANDLED_BY READS WRITES DEPENDS_ON CONTINUES_TO TESTS "
    "CONTAINS REFERENCES RUNS CONFIGURES DOCUMENTS USES_ENV"
).split()
#: Relationships that couple two nodes: all but nesting.
COUPLING = [r for r in RELATIONSHIPS if r not in ("DECLARES", "CONTAINS")]
#: Strongest first.
CONFIDENCES = ["CERTAIN", "RESOLVED", "INFERRED", "AMBIGUOUS"]
ECOSYSTEMS = "npm python maven gradle go cargo composer nuget bundler".split()
EXTERNAL_KINDS = [*ECOSYSTEMS, "node", "stdlib", "builtin", "outside-analysis"]
ROLES = "Controller Service Repository Middleware Model Test".split()
DECLARATIONS = "Class Interface TypeAlias Enum EnumMember Function Method Property Accessor Constructor Variable Namespace".split()
KINDS = ["File", *DECLARATIONS, *"Route EnvironmentVariable External Manifest Dependency Technology ArtifactElement".split()]
#: Shallowest first.
DEPTHS = ["discovered", "syntactic", "semantic", "framework"]
FINDINGS = (
    "declaration-never-referenced exported-declaration-never-imported declaration-isolated file-high-fan-in file-high-fan-out "
    "declaration-in-dependency-cycle file-in-import-cycle route-without-handler route-registered-twice environment-variable-never-read "
    "unresolved-relationships-limit-analysis"
).split()

#: Kinds that may stand at the source and at the target of each relationship.
ENDPOINTS = {
    "DECLARES": (["File", "Class", "Interface", "Enum", "Namespace", "Function", "Method", "Constructor", "Accessor", "Property", "Variable"], DECLARATIONS),
    "IMPORTS": (["File"], ["File", "External", *DECLARATIONS]),
    "EXPORTS": (["File"], ["File", "External", *DECLARATIONS]),
    "EXTENDS": (["Class", "Interface"], ["Class", "Interface", "TypeAlias", "Function", "Variable", "External"]),
    "IMPLEMENTS": (["Class", "Enum"], ["Interface", "TypeAlias", "Function", "Variable", "External"]),
    "CALLS": (["File", *DECLARATIONS], [*DECLARATIONS, "External"]),
    "DEPENDS_ON": (["Manifest", "ArtifactElement"], ["Dependency", "ArtifactElement"]),
    "HANDLED_BY": (["Route"], DECLARATIONS),
    "CONTINUES_TO": (["File", *DECLARATIONS], ["Route"]),
    "READS": (["File", *DECLARATIONS], ["EnvironmentVariable"]),
    "REFERENCES_TYPE": (DECLARATIONS, ["Class", "Interface", "TypeAlias", "Enum", "EnumMember", "Function", "Variable", "Namespace", "External"]),
    "CONTAINS": (["File", "ArtifactElement"], ["ArtifactElement"]),
    "REFERENCES": (["File", "ArtifactElement"], ["File"]),
    "RUNS": (["File", "ArtifactElement"], ["File"]),
    "CONFIGURES": (["File"], ["Technology"]),
    "DOCUMENTS": (["File"], ["File"]),
    "USES_ENV": (["File", "ArtifactElement"], ["EnvironmentVariable"]),
}
