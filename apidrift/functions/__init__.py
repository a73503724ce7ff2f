"""Column functions: text, versions and change wording. All run inside the JVM."""
