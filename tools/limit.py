"""A time limit for what a session runs."""

import threading
from contextlib import contextmanager


@contextmanager
def limited(spark, seconds: float):
    """Cancel the session's jobs once the limit is over, and those that follow until the block ends."""
    done = threading.Event()

    def watch():
        if not done.wait(seconds):
            while not done.wait(1):
                spark.sparkContext.cancelAllJobs()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
