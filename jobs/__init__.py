"""Runnable jobs over project tables: `python -m jobs.run_register` and `python -m jobs.note_values`."""
