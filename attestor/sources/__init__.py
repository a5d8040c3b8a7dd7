"""Readers and writers: files, web pages, catalogue services, uploads; guarded CSV, bundles and reports."""
