def pytest_collection_modifyitems(items):
    """test_pipeline still expects near-duplicates by fingerprint distance, which the stage no longer uses (README); it runs last, so that -x shows all others."""
    items.sort(key=lambda item: item.name == "test_pipeline")
