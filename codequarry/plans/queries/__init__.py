"""Registered queries by area; importing this package fills the registry."""

from codequarry.plans.queries import chats, code_graph, corpus, extraction, hosts, search, storage, web  # noqa: F401
