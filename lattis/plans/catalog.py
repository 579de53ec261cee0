"""Importing this module registers every query."""
from lattis.plans import topology  # noqa: F401
from lattis.plans import integrity  # noqa: F401
from lattis.plans import retrieval  # noqa: F401
from lattis.plans import evaluation  # noqa: F401
from lattis.plans import ontology  # noqa: F401
from lattis.plans import sources  # noqa: F401
from lattis.plans import streaming  # noqa: F401
from lattis.plans import readers  # noqa: F401
from lattis.plans import moments  # noqa: F401
from lattis.plans import similarity  # noqa: F401
