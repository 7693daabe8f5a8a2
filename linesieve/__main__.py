from linesieve.cli import main

raise SystemExit(main())
