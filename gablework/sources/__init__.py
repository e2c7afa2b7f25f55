"""Readers: table access, transcript and feed parsers, crawl and sitemap inputs."""
