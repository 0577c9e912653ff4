"""Runnable jobs: each module is a command line around a function that takes a session."""
