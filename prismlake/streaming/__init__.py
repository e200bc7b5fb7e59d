"""Stateful compression of request streams."""
