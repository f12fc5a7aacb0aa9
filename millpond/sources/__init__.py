"""Readers: tables with a high-water mark, landed JSON feeds, paged APIs, API specs."""
