"""Plans and registered queries; importing the package registers all of them."""

from graphloom.plans import correction_queries, queries, step_queries  # noqa: F401
